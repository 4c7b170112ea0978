"""What the trained text operators share: folds, bounded samples, a linear
support vector machine and a calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starlane.session import write_and_read


CLASSES = 10_000  # whose sizes are broadcast


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds`` (a null id counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def class_sample(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows of each label, those of the smallest hash of
    ``doc_id``.  The class sizes give a bound for the hash that hardly more rows
    can stay below, so only about that many meet, however large a class is: the
    sizes, one row a class, are broadcast (up to ``CLASSES`` of them), and rows are filtered where they are read."""
    sizes = write_and_read(labelled.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size")), "class-sizes")
    if sizes.count() <= CLASSES:
        sizes = F.broadcast(sizes)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11).cast("double") / float(1 << 53)
    enough = per_class + 4 * per_class**0.5 + 10
    low = labelled.join(sizes, F.col(label) == F.col("_label")).withColumn("_draw", draw).filter(F.col("_draw") * F.col("_size") <= enough)
    order = W.partitionBy(label).orderBy("_draw", "doc_id")
    ranked = low.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_class)
    return ranked.select(labelled.columns)


def within_budget(sample: DataFrame, label: str, size: str, budget: int) -> DataFrame:
    """The rows of a sample, in order of their hash, until the column ``size``
    adds up to the budget of their class; the first row of a class stays."""
    order = W.partitionBy(label).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").rowsBetween(W.unboundedPreceding, -1)
    return sample.withColumn("_before", F.coalesce(F.sum(size).over(order), F.lit(0))).filter(F.col("_before") < budget).drop("_before")


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 20, seed: int = 0) -> np.ndarray:
    """Hinge loss with L2 regularisation by dual coordinate descent.

    ``rows`` are sparse (indices, values) and ``y`` is +1 or -1; ``cost``
    bounds each dual variable.  A bias is an ordinary feature of the caller.
    """
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            if not square[i]:
                continue
            step = (1.0 - y[i] * float(w[at] @ v)) / square[i]
            new = min(max(alpha[i] + step, 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def calibrate(margins: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Newton steps with
    a weak prior, so that separable classes stay finite)."""
    a, b = 1.0, 0.0
    weight = weight / weight.sum() * len(weight) if len(weight) else weight
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(weight * (p - positive) * margins).sum() + 0.05 * (a - 1), (weight * (p - positive)).sum() + 0.05 * b])
        h = weight * p * (1 - p)
        second = np.array([[(h * margins**2).sum() + 0.05, (h * margins).sum()], [(h * margins).sum(), h.sum() + 0.05]])
        step = np.linalg.solve(second, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def probability(margins: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * margins + curve[1], -30, 30)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(text: str, size: int, overlap: int):
    """A long text in overlapping pieces, so that arrays stay small."""
    if len(text) <= size:
        yield text
        return
    for at in range(0, len(text), size):
        yield text[max(0, at - overlap) : at + size]
