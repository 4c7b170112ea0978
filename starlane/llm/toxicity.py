"""Toxicity: subsequence string-kernel support vectors with Nyström landmarks.

A sentence is a row of spans: its words, lower-cased, without the marks at
their ends and with a space on either side; letters spelled out one by one ("a b c") make one span.  The kernel of
two spans counts the subsequences of ``ORDER`` characters that they share.
Characters of a subsequence may lie up to ``REACH`` places apart, and each
place skipped multiplies its weight by ``DECAY``; values are divided by the
square root of the spans' lengths.  So a word with marks or letters put
between its own keeps most of what it shares with the plain word.

Training sees labelled sentences of a bounded sample (``SAMPLE`` texts of each
class of at most ``CHARS`` code points).  Every span of a clean text is a clean
example.  A toxic text says only that one of its spans is toxic: the span
that tells the classes apart best stands for it (with others about as good), first
by its counts, then by the model, which is fitted again.  Landmarks are frequent spans of both kinds; the
Nyström map makes their kernel values features, and a linear hinge-loss model
on them is a weight for each subsequence, so a whole text is scored in one
pass over its characters.  A text is as toxic as its strongest span, and a
logistic curve fitted on other texts makes that a probability.

Texts are read whole, in pieces cut at line ends or spaces, so a long text needs
no more memory.  Null and empty texts score as one without spans.  Without labels
of both classes the score is the share of label 1 (0 without any).  Rows are
treated one by one: ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.llm import learning, text as tx

ORDER, REACH, DECAY = 3, 3, 0.6
SLOT_BITS = 18
SAMPLE = 2000
CHARS = 12_000
LANDMARKS = 200  # of each kind
CLEAN_SPANS = 8_000  # clean examples, drawn from those of the sample
ROUNDS = 2
COST = 4.0
STRONG, CLOSE = 3.0, 0.7  # a span is strong at this log-odds, if this near the best of its text
PIECE = 1 << 17

_EDGES = re.compile(r"(?<!\S)[^\w\s]+|[^\w\s]+(?!\S)")  # marks at the ends of words
#: Offsets of the second and third character, and the weight of each shape.
SHAPES = [(a, a + b, DECAY ** (a + b - 2)) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]


def spans_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text as ``" word word "`` and the place of the space
    before each span (and after the last)."""
    cp = learning.code_points(f" {' '.join(_EDGES.sub(' ', text.lower()).split())} ")
    space = np.flatnonzero(cp == 32)
    if len(space) > 3:
        single = np.diff(space) == 2
        inner = np.flatnonzero(single[1:] & single[:-1]) + 1  # spaces between one-character words
        if len(inner):
            keep = np.ones(len(cp), bool)
            keep[space[inner]] = False
            cp = cp[keep]
            space = np.flatnonzero(cp == 32)
    return cp, space


def _each_shape(cp: np.ndarray, space: np.ndarray):
    """For each shape: slots of the subsequences by the place of their first
    character, and which of them stay within their span."""
    n = len(cp)
    x = cp.astype(np.uint64)
    limit = np.repeat(space[1:], np.diff(space))  # the space after the span that a place belongs to
    first = x * np.uint64(0x9E3779B97F4A7C15)
    second = x * np.uint64(0xC2B2AE3D27D4EB4F)
    third = x * np.uint64(0x165667B19E3779F9)
    for a, b, weight in SHAPES:
        size = n - b
        if size <= 0:
            continue
        h = first[:size] + second[a : a + size]
        h ^= h >> np.uint64(29)
        h += third[b:]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        m = min(size, len(limit))
        yield (h[:m] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.arange(b, b + m) <= limit[:m], weight


def span_values(text: str, weights: np.ndarray) -> np.ndarray:
    """The sum of weights over the subsequences of every span, by its length."""
    cp, space = spans_of(text)
    if len(space) < 2 or len(cp) < 3:
        return np.zeros(0, np.float32)
    total = np.zeros(space[-1], np.float32)
    for slots, inside, weight in _each_shape(cp, space):
        total[: len(slots)] += np.where(inside, weights[slots], 0) * np.float32(weight)
    return np.add.reduceat(total, space[:-1]) / np.sqrt(np.diff(space) + 1)


def span_features(span: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of the subsequences of one span (without its spaces)."""
    cp = learning.code_points(f" {span} ")
    space = np.array([0, len(cp) - 1])
    slots, values = [], []
    for s, inside, weight in _each_shape(cp, space):
        slots.append(s[inside])
        values.append(np.full(int(inside.sum()), weight))
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0)
    at, place = np.unique(np.concatenate(slots), return_inverse=True)
    return at, np.bincount(place, np.concatenate(values)) / np.sqrt(len(cp))


def text_pieces(text: str):
    while len(text) > PIECE:
        cut = max(text.rfind("\n", 0, PIECE), text.rfind(" ", 0, PIECE))
        cut = cut if cut > 0 else PIECE
        yield text[:cut]
        text = text[max(cut - (32 if cut == PIECE else 0), 1) :]
    yield text


@dataclass
class Model:
    weights: np.ndarray  # of a subsequence
    bias: float
    curve: tuple[float, float]

    def margin(self, text: str) -> float:
        best = -1.0
        for piece in text_pieces(text):
            values = span_values(piece, self.weights)
            if len(values):
                best = max(best, float(values.max()) + self.bias)
        return best


def constant(p: float) -> Model:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << SLOT_BITS, np.float32), 0.0, (1e-3, float(np.log(p / (1 - p)))))


def _span_list(text: str) -> list[str]:
    cp, space = spans_of(text)
    whole = cp.tobytes().decode("utf-32-le", "surrogatepass")
    return sorted({whole[a + 1 : b] for a, b in zip(space[:-1], space[1:], strict=True) if b > a + 1})


def _nystrom(spans: list[str]):
    """Map from spans to features, and from a linear model on them to weights."""
    rows = [span_features(s) for s in spans]
    slots = np.unique(np.concatenate([at for at, _ in rows]))
    matrix = np.zeros((len(rows), len(slots)))
    for i, (at, v) in enumerate(rows):
        matrix[i, np.searchsorted(slots, at)] = v
    values, vectors = np.linalg.eigh(matrix @ matrix.T)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    basis = matrix.T @ root  # slots x features

    def features(span: str) -> np.ndarray:
        at, v = span_features(span)
        place = np.minimum(np.searchsorted(slots, at), len(slots) - 1)
        known = slots[place] == at
        return v[known] @ basis[place[known]]

    def weights(w: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << SLOT_BITS, np.float32)
        out[slots] = basis @ w
        return out

    return features, weights


def learn(texts: list[list[str]], y: np.ndarray, seed: int = 7) -> Model:
    """Fit span weights on texts given as span lists (see the module's text)."""
    rng = np.random.default_rng(seed)
    toxic, clean = Counter(), Counter()
    for spans, label in zip(texts, y, strict=True):
        (toxic if label else clean).update(spans)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    odds = {s: np.log((n + 0.1) / (n1 + 1)) - np.log((clean[s] + 0.1) / (n0 + 1)) for s, n in toxic.items()}
    best = [max(spans, key=lambda s: (odds[s], s)) for spans, label in zip(texts, y, strict=True) if label and spans]
    strong: Counter[str] = Counter()
    for spans, label, top in ((x, c, max((odds[s] for s in x), default=0)) for x, c in zip(texts, y, strict=True) if c):
        strong.update(s for s in spans if odds[s] > top - CLOSE and odds[s] > STRONG)
    negatives = sorted(clean)
    if len(negatives) > CLEAN_SPANS:
        negatives = [negatives[i] for i in np.sort(rng.choice(len(negatives), CLEAN_SPANS, replace=False))]
    cache: dict[str, np.ndarray] = {}
    model = constant(0.5)
    for again in range(ROUNDS):
        counts = Counter(best) if again else strong | Counter(best)
        positives = sorted(counts)
        ranked = sorted(positives, key=lambda s: (-counts[s], s))[:LANDMARKS]
        common = [s for s, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[: LANDMARKS // 2]]
        other = [negatives[i] for i in rng.choice(len(negatives), min(LANDMARKS // 2, len(negatives)), replace=False)]
        features, weights = _nystrom(list(dict.fromkeys([*ranked, *common, *other])))
        cache = {s: features(s) for s in [*positives, *negatives]}
        names = [s for s in positives if s not in clean or counts[s] > clean[s]] + negatives
        sign = np.array([1.0] * (len(names) - len(negatives)) + [-1.0] * len(negatives))
        if not (sign > 0).any():
            break
        size = len(cache[names[0]])
        rows = [(np.arange(size + 1), np.r_[cache[s], 1.0]) for s in names]
        cost = np.where(sign > 0, [COST * (1 + np.log(counts[s] or 1)) for s in names], COST)
        w = learning.linear_svm(rows, sign, cost, size + 1, epochs=12)
        model = Model(weights(w[:size]), float(w[size]), (1.0, 0.0))
        best = []
        for spans, label in zip(texts, y, strict=True):
            if label and spans:
                values = span_values(" ".join(spans), model.weights) if len(spans) > 1 else np.zeros(1)
                best.append(max(zip(values, spans, strict=False))[1] if len(values) == len(spans) else max(spans, key=lambda s: (odds[s], s)))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str) -> Model:
    """Learn from ``doc_id`` and ``text`` of ``docs`` and the 0/1 column
    ``label`` of ``labels``, by ``doc_id``.  The sample is drawn from the labels
    alone, so only its texts are fetched."""
    usable = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    sizes = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return constant(1.0 if 1 in sizes else 0.0)
    chosen = F.broadcast(learning.class_sample(usable, "y", SAMPLE))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.char_length("text") <= CHARS)

    def make():
        return lambda texts: [pa.array([_span_list(t.as_py()) for t in texts], pa.list_(pa.string()))]

    rows = tx.annotate(sample, make, "spans array<string>", ["doc_id", "y", "text"]).select("row.*", "spans").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.y))
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        return constant(sizes.get(1, 0) / sum(sizes.values()))
    held = np.zeros(len(y), bool)  # every fifth row of each class calibrates
    for c in (0, 1):
        held[np.flatnonzero(y == c)[4::5]] = True
    model = learn([r.spans for r, h in zip(rows, held, strict=True) if not h], y[~held])
    check = np.flatnonzero(held) if len(set(y[held].tolist())) == 2 else np.arange(len(y))
    margins = np.array([model.margin(rows[i].text) for i in check])
    each = np.array([sizes[c] / max((y[check] == c).sum(), 1) for c in (0, 1)])
    model.curve = learning.calibrate(margins, (y[check] == 1).astype(float), each[y[check]])
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns as ``row``, and ``score`` (0 to 1, higher: toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            margins = np.array([model.margin(t.as_py() or "") for t in texts])
            return [pa.array(learning.probability(margins, model.curve))]

        return work

    return tx.annotate(docs, make, "score double", keep)
