"""Language identification with a string kernel.

The kernel is the blended spectrum: how many n-grams (1 to ``LONGEST`` code
points, lower-cased, everything but letters read as a space) two texts have in
common, presence only, divided by the square root of the number each has.  It
is taken over the n-grams that occur in the landmarks.

Landmarks are ``LANDMARKS`` labelled texts of each language; the Nyström map
turns the kernel values against them into features, and a one-versus-rest
kernel ridge regression is solved on ``SAMPLE`` labelled texts of each
language (both are bounded samples; landmarks are whole texts, as many as have about ``CHARS`` code
points together).  Scoring reads each whole text, marks its n-grams in a row of a
presence matrix, and multiplies a block of rows by the landmark matrix.

Only text and labels of the training fold are used to learn, only text to
predict.  Null texts and texts without letters get ``und`` and score 0; with no
labels at all every text does.  Rows are treated one by one, so ties, repeated
rows and extra columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.llm import learning, text as tx

LONGEST = 3
LANDMARKS = 24
SAMPLE = 400
SHORTEST = 20  # code points of a landmark, if there are such texts
CHARS = 100_000  # code points of the landmarks of a language, about
RIDGE = 1e-2
TABLE_BITS = 22
BLOCK = 64  # rows of a presence matrix
PIECE = 1 << 18
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter, made once in a Python worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_slots(text: str) -> tuple[np.ndarray, bool]:
    """Hash slots of all n-grams of a text, and whether it has a letter."""
    cp = learning.code_points(f" {text.lower()} ")
    letter = letter_table()[cp]
    cp = np.where(letter, cp, 32).astype(np.uint64)
    out, h = [], cp
    for n in range(1, LONGEST + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0x110003) + cp[n - 1 :]
        out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS))
    return np.concatenate(out).astype(np.int64), bool(letter.any())


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # slot -> column of the presence matrix, or the last one (unused)
    landmarks: np.ndarray  # presence of each column in each landmark, scaled
    weights: np.ndarray  # kernel values -> one score for each label
    bias: np.ndarray

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised kernel values against the landmarks; which texts have letters."""
        width = len(self.landmarks)
        seen = np.zeros((len(texts), width + 1), np.uint8)
        lettered = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            for piece in learning.pieces(text, PIECE, LONGEST):
                slots, has = gram_slots(piece)
                seen[i, self.table[slots]] = 1
                lettered[i] |= has
        seen = seen[:, :width].astype(np.float32)
        size = np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1))
        return (seen @ self.landmarks) / size, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), BLOCK):
            kernel, lettered = self.kernel(texts[at : at + BLOCK])
            if not self.labels:
                names += [UNKNOWN] * len(lettered)
                continue
            raw = 4 * (kernel @ self.weights + self.bias)
            p = np.exp(raw - raw.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            names += [self.labels[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            scores[at : at + len(best)] = np.where(lettered, p.max(1), 0.0)
        return names, scores


def unique_slots(text: str) -> np.ndarray:
    """The hash slots of a whole text, each once."""
    parts = [np.unique(gram_slots(piece)[0]) for piece in learning.pieces(text, PIECE, LONGEST)]
    return np.unique(np.concatenate(parts))


def _with_landmarks(grams: list[np.ndarray]) -> Model:
    known = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
    table = np.full(1 << TABLE_BITS, len(known), np.int32)
    table[known] = np.arange(len(known))
    landmarks = np.zeros((len(known), len(grams)), np.float32)
    for j, g in enumerate(grams):
        landmarks[table[g], j] = 1 / np.sqrt(len(g))
    return Model([], table, landmarks, np.zeros((len(grams), 0)), np.zeros(0))


def fit(labelled: DataFrame) -> Model:
    """Learn from ``doc_id``, ``text`` and a non-null ``lang``."""
    spark = labelled.sparkSession
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sized = usable.withColumn("size", F.char_length("text"))
    lettered = sized.filter(F.col("text").rlike(r"\p{L}"))
    enough = lettered.filter(F.col("size") >= SHORTEST)
    long_enough = lettered if enough.isEmpty() else enough
    chosen = learning.class_sample(long_enough.select("doc_id", "lang", "size"), "lang", LANDMARKS)
    chosen = learning.within_budget(chosen, "lang", "size", CHARS).select("doc_id", "lang")

    def slots():
        return lambda texts: [pa.array([unique_slots(t.as_py()).astype(np.int32).tobytes() for t in texts], pa.binary())]

    marks = tx.annotate(usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi"), slots, "slots binary", ["doc_id", "lang"])
    rows = sorted(marks.collect(), key=lambda r: (r.row.lang, r.row.doc_id is None, r.row.doc_id))
    model = _with_landmarks([np.frombuffer(bytes(r.slots), np.int32).astype(np.int64) for r in rows])
    if not model.landmarks.size:
        return model
    shared = spark.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            values = texts.to_pylist()
            kernel = np.concatenate([model.kernel(values[i : i + BLOCK])[0] for i in range(0, len(values), BLOCK)])
            return [pa.array([k.astype(np.float32).tobytes() for k in kernel], pa.binary())]

        return work

    picked = F.broadcast(learning.class_sample(usable.select("doc_id", "lang"), "lang", SAMPLE))
    sample = tx.annotate(usable.join(picked, ["doc_id", "lang"], "left_semi"), make, "kernel binary", ["lang"])
    rows = sorted((r.row.lang, bytes(r.kernel)) for r in sample.collect())
    labels = sorted({lang for lang, _ in rows})
    kernel = np.stack([np.frombuffer(k, np.float32) for _, k in rows]).astype(np.float64)
    between = (model.landmarks.T @ model.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(between)
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6 * values.max())))  # Nyström map
    features = kernel @ root
    target = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    centre, middle = features.mean(0), target.mean(0)
    f, t = features - centre, target - middle
    solved = np.linalg.solve(f.T @ f + RIDGE * len(f) * np.eye(f.shape[1]), f.T @ t)
    return Model(labels, model.table, model.landmarks, (root @ solved).astype(np.float32), (middle - centre @ solved).astype(np.float32))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns as ``row``, ``lang_pred`` and ``score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            names, scores = model.predict([t.as_py() or "" for t in texts])
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return tx.annotate(docs, make, "lang_pred string, score double", keep)
