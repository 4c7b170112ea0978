"""Vector codes against plain Lloyd rounds over all parts."""

import hashlib
import math

import pytest

from starlane.llm import vector_codes as vc
from starlane.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, parts=8, entries=16, rounds=6):
    """``rows`` are ``(vec_id, vector, label)``; codes, errors and the digest."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in good]
    width = len(whole[0]) // parts
    cut = [[tuple(w[p * width : (p + 1) * width]) for p in range(parts)] for w in whole]
    first = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, good[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, part: min((square(part, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(p, c[p])[1], []).append(c[p])
            for k, group in groups.items():
                books[p][k] = tuple(sum(x) // len(group) for x in zip(*group, strict=True))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = []
    for (vec_id, _, label), c in zip(good, cut, strict=True):
        best = [near(p, part) for p, part in enumerate(c)]
        out.append((vec_id, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    by_label = {}
    for _, label, _, error in out:
        by_label[label] = by_label.get(label, 0) + error
    return sorted(((v, code, error, by_label[label], digest) for v, label, code, error in out), key=str)


def got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(QUERIES["op12_vector_codes"](spark, SF)) == brute(rows)


def test_nulls_ties_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vector = lambda k: [((k * 37 + j * 101) % 97 - 48) / 60 for j in range(16)]
    rows = [(k, vector(k % 40), k % 3 if k % 5 else None) for k in range(120)]
    rows += [(500 + k, vector(7), 1) for k in range(200)]  # one vector holds most rows
    rows += [(3, vector(41), 2), (3, vector(3), 2), (None, vector(42), 2)]
    bad = [(900, None, 1), (901, [None] * 16, 1), (902, [nan] * 16, 1), (903, [0.0] * 15 + [inf], 1), (904, [-inf] + [0.0] * 15, None), (905, [], 1), (906, [1.0] * 24, 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").repartition(5)
    done = vc.compress(table.withColumn("a.b", vc.F.lit("x")).withColumn("code", vc.F.lit("y")))
    assert got(done.select("row.vec_id", "code", "error", "label_error", "codebooks_sha256")) == brute(rows)
    assert done.select("row").schema["row"].dataType.names == ["vec_id", "embedding", "label", "a.b", "code"]


def test_members_stay_where_they_are(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = vc.fit(table)
    parts = 8 * table.count()
    assert books.history[0] == 0 and len(books.history) == 6
    assert all(0 < moved < parts / 2 for moved in books.history[1:3]) and books.history[5] < books.history[1]


def test_few_rows_and_none(spark):
    few = [(k, [k / 10 - 0.05 * j for j in range(8)], None) for k in range(5)]
    table = spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")
    rows = [tuple(r) for r in table.collect()]
    assert got(vc.compress(table).select("row.vec_id", "code", "error", "label_error", "codebooks_sha256")) == brute(rows)
    none = vc.compress(table.limit(0))
    assert none.collect() == [] and none.columns == ["row", "code", "error", "label_error", "codebooks_sha256"]
    assert vc.compress(spark.createDataFrame([(1, None, 1)], table.schema)).collect() == []


def test_too_large_components(spark):
    table = spark.createDataFrame([(1, [70000.0] * 8, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="cannot be coded"):
        vc.compress(table).collect()
