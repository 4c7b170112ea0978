import random

import pytest
from pyspark.sql import functions as F

from starlane.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, n):
    chars = list(line)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars.insert(at, rng.choice("abcé𝄞"))
        elif kind == 1:
            del chars[at]
        else:
            chars[at] = rng.choice("abcé𝄞")
    return "".join(chars)


def brute(rows, tau, least):
    places = {}
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                places.setdefault(line, []).append((doc, no))
    lines = list(places)
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if abs(len(x) - len(y)) <= tau and distance(x, y) <= tau:
                parent[find(x)] = find(y)
    first = {}
    for line, at in places.items():
        first[find(line)] = min(first.get(find(line), min(at)), min(at))
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        out[doc] = None if text is None else "\n".join(x for no, x in enumerate(lines) if len(x) < least or first[find(x)] == (doc, no))
    return out


def corpus(seed, bases, variants):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh é", k=rng.choice([20, 21, 25, 40, 90]))) for _ in range(bases)]
    pool = base + [edited(rng, x, rng.choice([0, 1, 1, 2, 2, 3, 4])) for x in base for _ in range(variants)]
    pool += ["short", "", "  "]
    rows = [(i * 2, "\n".join(rng.choices(pool, k=rng.randint(0, 7)))) for i in range(len(pool) // 2)]
    return [*rows, (10_001, None), (10_003, base[0])]


@pytest.mark.parametrize(("bases", "variants", "bucket"), [(30, 4, 16), (4, 60, 3)])
def test_against_all_pairs(spark, monkeypatch, bases, variants, bucket):
    monkeypatch.setattr(line_dedup, "SMALL_BUCKET", bucket)
    rows = corpus(bases, bases, variants)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lines string")
    want = brute(rows, line_dedup.TAU, line_dedup.MIN_CHARS)
    done = line_dedup.dedup_lines(docs)
    got = {r.doc_id: r.text for r in done.select("row.doc_id", F.array_join("lines", "\n").alias("text")).collect()}
    assert got == want
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    texts = dict(rows)
    assert {r.doc_id: r.text for r in kept.collect()} == {d: t for d, t in want.items() if t == texts[d] or t.strip()}


def test_bit_parallel_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("ab", k=rng.randint(2, 60)))
        pairs.append((a, edited(rng, a, rng.randint(0, min(4, len(a) - 2))) if rng.random() < 0.7 else "".join(rng.choices("ab", k=rng.randint(2, 14)))))
    pairs = [(a, b) for a, b in pairs if min(len(a), len(b)) >= 2]
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup.within_tau(F.col("x"), F.col("y")).alias("near")).collect()
    assert [(r.x, r.y, r.near) for r in got] == [(a, b, distance(a, b) <= line_dedup.TAU) for a, b in pairs]


def test_edges(spark):
    line = "a line that is long enough"
    huge = "z" * 50_000
    rows = [(1, line + "\n" + line), (2, line), (2, line), (3, huge), (4, huge + "y"), (5, ""), (6, None), (None, line), (7, "x\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.row.doc_id or 99, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()))
    assert got == [(1, 2, 1), (2, 1, 1), (2, 1, 1), (3, 1, 0), (4, 1, 1), (5, 1, 0), (6, 0, 0), (7, 2, 0), (99, 1, 1)]
    assert sorted(r.doc_id for r in line_dedup.without_repeated_lines(docs).collect()) == [1, 3, 5, 6, 7]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
