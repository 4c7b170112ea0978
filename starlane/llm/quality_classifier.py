"""Quality classifier: naive Bayes support vectors over shape n-grams.

A text is read twice as a sequence of symbols: its characters by kind (capital,
small letter, digit, space, line end, or the mark itself), and its words by
shape (capitals, digits, marks, the last mark, and whether the word repeats one
of the two before it).  Indicators of the n-grams of both are hashed to
``SLOTS`` features.  Features are scaled by the log-ratio of their class counts, each
text is scaled to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent.  A logistic curve on other rows of the sample turns
margins into probabilities at the true class sizes.

Learning uses a bounded sample: ``SAMPLE`` labelled texts of each class, of at
most ``CHARS`` code points.  Scoring reads whole texts, in pieces, so a long
text needs no more memory.  Null and empty texts get the score of a text without
features.  Without labels of both classes the score is the share of label 1
(or 1 without any).  Rows are treated one by one: ties, repeated rows and extra
columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.llm import learning, text as tx

SLOTS = 1 << 16
CHAR_GRAMS, WORD_GRAMS = 4, 3
SAMPLE = 2500
CHARS = 50_000
COST = 1.0
PIECE = 1 << 18
_kinds: list[np.ndarray] = []


def kind_table() -> np.ndarray:
    """Symbol of each code point: 1 capital, 2 small or other letter, 3 digit,
    4 space, 5 line end, 6 other mark; ASCII marks are their own."""
    if not _kinds:
        kinds = np.full(0x110000, 6, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                kinds[c] = 1 if ch.isupper() else 2
            elif ch.isdigit():
                kinds[c] = 3
            elif ch.isspace():
                kinds[c] = 4
        kinds[10] = 5
        marks = [c for c in range(33, 127) if kinds[c] == 6]
        kinds[marks] = np.arange(7, 7 + len(marks))
        _kinds.append(kinds)
    return _kinds[0]


def _grams(symbols: np.ndarray, longest: int, salt: int) -> list[np.ndarray]:
    out, h = [], symbols.astype(np.uint64) + np.uint64(salt)
    for n in range(1, longest + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + symbols[n - 1 :].astype(np.uint64)
        out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
    return out


def _piece_features(text: str) -> list[np.ndarray]:
    cp = learning.code_points(text)
    if not len(cp):
        return []
    kinds = kind_table()[cp]
    out = _grams(kinds, CHAR_GRAMS, 1 << 20)
    inside = (kinds != 4) & (kinds != 5)
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return out
    count = lambda flags: np.add.reduceat(flags[: ends[-1]].astype(np.int32), starts)
    upper, lower, digit = count(kinds == 1), count(kinds == 2), count(kinds == 3)
    last = kinds[ends - 1]
    words = np.add.reduceat(np.where(inside, cp.astype(np.uint64) * (np.arange(len(cp), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), 0)[: ends[-1]], starts)
    spelled = tx.mix(words - np.uint64(2) * starts.astype(np.uint64) * np.add.reduceat(np.where(inside, cp, 0).astype(np.uint64)[: ends[-1]], starts))
    again = np.zeros(len(starts), np.int64)
    again[2:] += 2 * (spelled[2:] == spelled[:-2])
    again[1:] += spelled[1:] == spelled[:-1]
    case = np.where(upper == 0, 0, np.where(lower == 0, np.where(upper > 1, 3, 2), np.where(upper == 1, 1, 4)))
    shape = (((case * 2 + (digit > 0)) * 2 + (upper + lower == 0)) * 4 + again) * 64 + np.where(last > 6, last, 0)
    return out + _grams(shape, WORD_GRAMS, 2 << 20)


def features(text: str, scratch: np.ndarray) -> np.ndarray:
    """Sorted features of a text; ``scratch`` is ``SLOTS`` zero bytes."""
    for piece in learning.pieces(text, PIECE, 64):
        for grams in _piece_features(piece):
            scratch[grams.astype(np.int64)] = 1
    found = np.flatnonzero(scratch)
    scratch[found] = 0
    return found.astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of an indicator
    squares: np.ndarray  # what an indicator adds to the squared length
    bias: float
    curve: tuple[float, float]

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        return float(self.weights[found].sum()) / max(float(np.sqrt(self.squares[found].sum())), 1e-9) + self.bias


def constant(p: float) -> Model:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Model(np.zeros(SLOTS), np.zeros(SLOTS), 0.0, (1e-3, float(np.log(p / (1 - p)))))


def fit(docs: DataFrame, labels: DataFrame, label: str) -> Model:
    """Learn from ``doc_id`` and ``text`` of ``docs`` and the 0/1 column
    ``label`` of ``labels``, by ``doc_id``.  The sample is drawn from the labels
    alone, so only its texts are fetched."""
    usable = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    sizes = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return constant(1.0 if 1 in sizes or not sizes else 0.0)
    chosen = F.broadcast(learning.class_sample(usable, "y", SAMPLE))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.coalesce(F.char_length("text"), F.lit(0)) <= CHARS)

    def make():
        scratch = np.zeros(SLOTS, np.uint8)
        return lambda texts: [pa.array([features(t.as_py() or "", scratch).tobytes() for t in texts], pa.binary())]

    rows = tx.annotate(sample, make, "found binary", ["doc_id", "y"]).select("row.*", "found").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.y))
    found = [np.frombuffer(bytes(r.found), np.int32) for r in rows]
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        return constant(sizes.get(1, 0) / sum(sizes.values()))
    held = np.zeros(len(y), bool)  # every fourth row of each class calibrates
    for c in (0, 1):
        held[np.flatnonzero(y == c)[3::4]] = True
    counts = np.ones((2, SLOTS))
    for f, c, h in zip(found, y, held, strict=True):
        if not h:
            counts[c, f] += 1
    share = counts / counts.sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    squares = ratio**2
    rows_in = []
    for f in found:
        v = ratio[f]
        v = v / max(np.sqrt(float(v @ v)), 1e-9)
        rows_in.append((np.r_[f, SLOTS], np.r_[v, 1.0]))
    sign = np.where(y == 1, 1.0, -1.0)
    use = np.flatnonzero(~held)
    cost = COST * np.where(y == 1, 1.0, (y == 1).sum() / max((y == 0).sum(), 1))
    w = learning.linear_svm([rows_in[i] for i in use], sign[use], cost[use], SLOTS + 1)
    model = Model(w[:SLOTS] * ratio, squares, float(w[SLOTS]), (1.0, 0.0))
    check = np.flatnonzero(held) if held.any() else use
    margins = np.array([model.margin(found[i]) for i in check])
    each = np.array([sizes[c] / max((y[check] == c).sum(), 1) for c in (0, 1)])
    model.curve = learning.calibrate(margins, (y[check] == 1).astype(float), each[y[check]])
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns as ``row``, and ``score`` (0 to 1, higher: label 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, scratch = shared.value, np.zeros(SLOTS, np.uint8)

        def work(texts: pa.Array) -> list[pa.Array]:
            margins = np.array([model.margin(features(t.as_py() or "", scratch)) for t in texts])
            return [pa.array(learning.probability(margins, model.curve))]

        return work

    return tx.annotate(docs, make, "score double", keep)
