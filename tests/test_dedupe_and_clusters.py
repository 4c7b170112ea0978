"""Fingerprint dedupe is exact; interleaved clusters let files be skipped by any key."""

from __future__ import annotations

import os
import tempfile
from dataclasses import replace
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from fixtures import ROWS, flat_frame
from pyspark.sql import functions as F
from test_plans import plan_of

from starlane.operators import clean as C
from starlane.plans import layout as L
from starlane.session import write_and_read
from starlane.sources.flat import FLAT_COLUMNS


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("bits", [64, 3, 1])
@pytest.mark.parametrize("most", [10**6, 0])
def test_stored_dedupe_is_exact(spark, bits, most, monkeypatch):
    """Also where short fingerprints collide, and where too many repeat."""
    monkeypatch.setattr(C, "REPEATED_ROWS", most)
    moved = tuple("x" if k == 5 else None if k == 4 else v for k, v in enumerate(ROWS[9]))
    swapped = tuple(None if k == 5 else "x" if k == 4 else v for k, v in enumerate(ROWS[9]))  # hashes skip nulls
    flat = write_and_read(flat_frame(spark, [*ROWS, *ROWS[:4], *ROWS[:2], moved, swapped]).repartition(5), "flat")
    assert _rows(C.dedupe_stored(flat, bits)) == _rows(flat.dropDuplicates())
    assert C.dedupe_stored(flat.limit(0)).count() == 0


def test_stored_marks_may_leave_columns_out(spark):
    """Rows that differ only in a column without a part in the mark both stay."""
    other = [tuple(None if n == "postal_code" else v for n, v in zip(FLAT_COLUMNS, r)) for r in ROWS[:3]]
    flat = flat_frame(spark, [*ROWS, *ROWS[:4], *other])
    mark = C.fingerprint([c for c in flat.columns if c != "postal_code"])
    stored = write_and_read(flat.withColumn("m", mark), "flat")
    assert _rows(C.dedupe_stored(stored, mark="m")) == _rows(flat.dropDuplicates())


def test_cleaning_hashes_no_stored_row_again(spark, monkeypatch):
    seen = []
    plain = C.dedupe_stored
    monkeypatch.setattr(C, "dedupe_stored", lambda df, *a, **k: seen.append(plain(df, *a, **k)) or seen[-1])
    flat = flat_frame(spark, [*ROWS, *ROWS[:3]])
    done = C.clean_parts(flat)
    assert _rows(done.lines) == _rows(C.clean_flat(flat))
    assert "_mark" not in done.lines.columns and "xxhash64" not in plan_of(seen[0])
    done.release()


def test_unique_rows_are_not_shuffled(spark):
    flat = write_and_read(flat_frame(spark), "flat")
    tree = plan_of(C.dedupe_stored(flat)).split("\n\n")[0]
    unique = tree[tree.index("Union") : tree.index("LeftSemi")]
    assert "LeftAnti" in unique and "Exchange hashpartitioning" not in unique


def _star_of_one_day(spark, star, n=20_000):
    fact = spark.range(n).select(
        F.lit(1.0).alias("sales"), F.lit(0).cast("bigint").alias("order_key"), F.lit(0).cast("bigint").alias("ship_key"),
        *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)).alias(k) for k in L.CLUSTER_KEYS],
    )
    orders = spark.sql("SELECT 'O' AS order_id, date'2020-01-01' AS order_date, 0L AS order_key")
    keys = {d: spark.range(1000).select(F.col("id").alias(k)) for d, k in (("dim_customers", "customer_key"), ("dim_products", "product_key"), ("dim_regions", "region_key"))}
    return replace(star, fact_sales=write_and_read(fact, "one-day"), dim_orders=orders, **keys, keyed=False)


def _files_with(path, key, value):
    hit = files = 0
    for f in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        column = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == key)
        spans = [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups)]
        files += 1
        hit += any(s.min <= value <= s.max for s in spans)
    return hit / files


def test_interleaved_files_can_be_skipped_by_any_key(spark, fixture_star):
    star = _star_of_one_day(spark, fixture_star)
    base = tempfile.mkdtemp(prefix="starlane-clusters-")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}  # 64 files of the day
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for order in ("linear", "interleaved"):
            L.write_clustered(star, os.path.join(base, order), order=order)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    share = lambda order, key: sum(_files_with(f"{base}/{order}", key, v) for v in (37, 411, 808)) / 3
    for key in L.CLUSTER_KEYS:
        assert share("interleaved", key) <= 0.6
    assert share("linear", "customer_key") <= 0.1 and share("linear", "product_key") > 0.9
    same = [_rows(L.read_layout(spark, f"{base}/{o}").select(*star.fact_sales.columns)) for o in ("linear", "interleaved")]
    assert same[0] == same[1]
    with pytest.raises(ValueError, match="unknown cluster order"):
        L.write_clustered(star, base, order="spiral")
