"""Distributed surrogate keys equal a dense rank, over many partitions."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from starlane.operators.keys import dense_codes


def _dense_rank(df, col):
    w = Window.orderBy(col)
    return {r[0]: r[1] for r in df.where(F.col(col).isNotNull()).distinct()
            .select(col, (F.dense_rank().over(w) - 1).alias("k")).collect()}


def test_string_keys_match_dense_rank(spark):
    rnd = random.Random(7)
    vals = [("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 6))),) for _ in range(6000)]
    vals += [(None,)] * 50
    df = spark.createDataFrame(vals, "k string").repartition(13)
    got = {r.k: r.key for r in dense_codes(df, "k", "key", num_partitions=11).collect()}
    assert got == _dense_rank(df, "k")
    assert sorted(got.values()) == list(range(len(got)))


def test_double_and_date_keys(spark):
    df = spark.createDataFrame([(float(x % 37) - 5.5, ) for x in range(500)], "k double")
    got = {r.k: r.key for r in dense_codes(df, "k", "key", num_partitions=7).collect()}
    assert got == _dense_rank(df, "k")
    d = spark.range(300).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 41).cast("int")).alias("d"))
    got = {r.d: r.key for r in dense_codes(d, "d", "key", num_partitions=5).collect()}
    assert got == _dense_rank(d, "d")


def test_more_partitions_than_values(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "k string")
    got = {r.k: r.key for r in dense_codes(df, "k", "key", num_partitions=16).collect()}
    assert got == {"x": 0, "y": 1}


def test_empty_input(spark):
    df = spark.createDataFrame([(None,)], "k string")
    assert dense_codes(df, "k", "key").count() == 0


def test_many_domains_one_pass(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["b", "a", "zz", "c"]) + str(rnd.randint(0, 40)) if rnd.random() > 0.1 else None,
             float(rnd.randint(-20, 20)) if rnd.random() > 0.1 else None,
             rnd.randint(0, 9))
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "s string, x double, i long").repartition(9)
    from starlane.operators.keys import dense_codes_many
    maps = dense_codes_many({"ks": (df, "s"), "kx": (df, "x"), "ki": (df, "i")}, num_partitions=6)
    for col, key in [("s", "ks"), ("x", "kx"), ("i", "ki")]:
        got = {r[col]: r[key] for r in maps[key].collect()}
        assert got == _dense_rank(df, col), col


def test_keys_independent_of_partitioning(spark):
    """Recomputing the maps with another input split or partition count
    gives the same keys -- a lost executor can never renumber a dimension."""
    from starlane.operators.keys import dense_codes_many
    rnd = random.Random(11)
    rows = [(f"k{rnd.randint(0, 900)}", float(rnd.randint(0, 50))) for _ in range(4000)]
    base = spark.createDataFrame(rows, "s string, x double")
    runs = []
    for parts, n in [(3, 4), (17, 9), (1, 23)]:
        maps = dense_codes_many({"ks": (base.repartition(parts), "s"), "kx": (base, "x")}, num_partitions=n)
        runs.append(({r.s: r.ks for r in maps["ks"].collect()}, {r.x: r.kx for r in maps["kx"].collect()}))
    assert runs[0] == runs[1] == runs[2]
