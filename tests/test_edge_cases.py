"""Inline edge cases (FIXTURES.md section 5)."""

from __future__ import annotations

import datetime as dt

import pytest
from fixtures import ROWS, flat_frame
from pyspark.sql import functions as F

from starlane.functions.buckets import equal_width_bin, frequency_bucket
from starlane.functions.money import round_half_away
from starlane.operators import clean as C
from starlane.operators.keys import attach_key, dense_codes
from starlane.operators.star import build_star
from starlane.plans import insights as I
from starlane.plans import reports as R


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, 1.0), (5, None)], "id long, postal_code double")
    out = dict(C.impute_mode(df).collect())
    assert out[5] == 1.0


def test_all_null_mode_leaves_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, postal_code double")
    assert [r.postal_code for r in C.impute_mode(df).collect()] == [None, None]


def test_impute_without_column_is_noop(spark):
    df = spark.createDataFrame([(1,)], "id long")
    assert C.impute_mode(df).columns == ["id"]


def test_codes_with_null(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",), ("c",)], "k string")
    codes = dense_codes(df, "k", "key")
    got = [r.key for r in attach_key(df.withColumn("i", F.monotonically_increasing_id()), codes, "k", "key")
           .orderBy("i").collect()]
    assert got == [1, -1, 0, 1, 2]


def test_null_natural_key_matches_with_minus_one(fixture_star):
    # the fixture line with a null product id is in the fact with key -1,
    # and the product dimension holds the null row with key -1
    assert fixture_star.fact_sales.where("product_key = -1").count() == 1
    assert fixture_star.dim_products.where("product_id is null and product_key = -1").count() == 1


def test_duplicate_rows_holding_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "a long, b string")
    assert C.dedupe_rows(df).count() == 1


def test_same_values_different_row_id(spark):
    rows = [r for r in ROWS if r[0] in (7, 8)]  # rows 7 and 8 (8 twice)
    flat = flat_frame(spark, rows)
    assert C.dedupe_rows(flat).count() == 2
    star = build_star(C.clean_flat(flat), stage_clean=False)
    assert star.fact_sales.count() == 1


def test_day_first_dates(spark):
    df = spark.createDataFrame([("8/11/2017",), ("08/11/2017",)], "order_date_s string")
    got = [r.order_date for r in C.parse_dates(df).collect()]
    assert got == [dt.date(2017, 11, 8)] * 2


def test_bad_date_strict_fails_lenient_quarantines(spark):
    df = spark.createDataFrame([("2020-13-01", "01/01/2020"), ("01/01/2020", "02/01/2020")],
                               "order_date_s string, ship_date_s string")
    with pytest.raises(Exception):
        C.parse_dates(df, strict=True).collect()
    good, bad = C.quarantine_dates(C.parse_dates(df, strict=False))
    assert good.count() == 1 and bad.count() == 1
    assert bad.first().order_date_s == "2020-13-01"


def test_ship_before_order_counted_and_kept(spark):
    flat = flat_frame(spark)
    clean = C.clean_flat(flat)
    assert C.invalid_date_count(clean).first().invalid_rows == 2  # rows 7 and 8
    assert clean.where("order_id = 'O5'").count() == 2


def test_product_fan_out_counts_twice(spark):
    rows = [r for r in ROWS if r[0] in (1, 3)]  # P1 under two names
    star = build_star(C.clean_flat(flat_frame(spark, rows)), stage_clean=False)
    total = R.finalize(R.sales_by_category(star)).first().total_sales
    assert total == pytest.approx(2 * (10.25 + 7.00))


def test_rounded_average_half_away(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (2.4,)], "x double")
    assert [r[0] for r in df.select(round_half_away("x")).collect()] == [3, -3, 2]


def test_zero_divisor_null_frequency_bucket_3plus(spark):
    rows = [tuple(v if i != 2 else None for i, v in enumerate(r)) for r in ROWS if r[0] in (1, 2)]
    star = build_star(C.clean_flat(flat_frame(spark, rows)), stage_clean=False)
    k5 = R.order_frequency_by_customer(star).collect()
    assert [r.avg_order_frequency for r in k5] == [None]
    buckets = I.frequency_buckets(R.order_frequency_by_customer(star)).collect()
    assert [(r.frequency_range, r.customers) for r in buckets] == [("3+", 1)]


def test_frequency_buckets(spark):
    vals = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.1]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(frequency_bucket("x")).collect()]
    assert got == ["1-2", "1", "1-2", "1-2", "2-3", "2-3", "3+"]


def test_top_k_tie_and_null_group(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), (None, 9)], "k string, v long")
    assert [r.k for r in I.top_k(df, "k", "v", 1).collect()] == ["a"]


def test_sample_larger_than_input(fixture_star):
    m3 = R.mart_shipping(fixture_star).count()
    assert I.shipping_sample(R.mart_shipping(fixture_star), n=100).count() == m3 < 100


def test_constant_histogram(spark):
    df = spark.createDataFrame([(4,), (4,), (4,)], "x long")
    lo, hi = df.agg(F.min("x")).scalar(), df.agg(F.max("x")).scalar()
    got = df.select(equal_width_bin("x", lo, hi, 20).alias("b")).groupBy("b").count().collect()
    assert [(r.b, r["count"]) for r in got] == [(1, 3)]


def test_lenient_pipeline_quarantines_and_continues(spark):
    rows = list(ROWS) + [(99, "O9", "2020-13-01", "02/01/2020", "Std", "C1", "Ann", "S", "US", "A",
                          "NY", "East", 100.0, "P1", "Tech", "Tech/Pen", "Pen", 1.0)]
    flat = flat_frame(spark, rows)
    with pytest.raises(Exception):
        C.clean_flat(flat).collect()
    clean = C.clean_flat(flat, strict=False)
    assert clean.where("order_id = 'O9'").count() == 0
    star = build_star(clean, stage_clean=False)
    assert R.finalize(R.headline_kpis(star)).first().total_orders == 8
