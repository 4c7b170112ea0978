"""Column helpers against plain-Python definitions (hypothesis-generated
values, evaluated in one Spark job per example batch)."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starlane.functions.buckets import equal_width_bin, frequency_bucket
from starlane.functions.money import round_half_away


def _half_away(x):
    return int(Decimal(repr(x)).quantize(Decimal(1), rounding=ROUND_HALF_UP))


FLOATS = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


def test_frequency_bucket(spark):
    """Labels at and around every edge, written out."""
    labels = {0.0: "1-2", 0.5: "1-2", 1.0: "1", 1.0000001: "1-2", 1.5: "1-2", 2.0: "1-2", 2.0000001: "2-3", 2.5: "2-3", 3.0: "2-3", 3.0000001: "3+", 10.0: "3+", None: "3+"}
    df = spark.createDataFrame([(x,) for x in labels], "x double")
    got = {r.x: r.b for r in df.select("x", frequency_bucket("x").alias("b")).collect()}
    assert got == labels


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(FLOATS, st.sampled_from([0.5, -0.5, 2.5, -2.5, 1.4999999])),
                min_size=1, max_size=60))
def test_round_half_away(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = {r.i: r.r for r in df.select("i", round_half_away("x").alias("r")).collect()}
    assert got == {i: _half_away(x) for i, x in enumerate(xs)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-3000, 3000), min_size=1, max_size=80))
def test_equal_width_bin(spark, xs):
    lo, hi = min(xs), max(xs)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x long")
    got = {r.i: r.b for r in df.select(
        "i", equal_width_bin("x", F.lit(lo), F.lit(hi), 20).alias("b")).collect()}
    for i, x in enumerate(xs):
        want = 1 if hi == lo else min(math.floor((x - lo) * 20.0 / (hi - lo)) + 1, 20)
        assert got[i] == want
        assert 1 <= got[i] <= 20
