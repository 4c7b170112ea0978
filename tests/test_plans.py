"""Plan checks: pruning reaches the scan, no Python in the hot path."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile

import pytest

from starlane.plans import lattice
from starlane.plans import layout as L
from starlane.plans.catalog import STAR_PLANS, compared


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture
def no_stored_aggregates(fixture_star):
    """Plans over the fact, whatever an earlier test has stored."""
    lattice.release(fixture_star)


@pytest.mark.parametrize("name", sorted(STAR_PLANS))
def test_no_python_udf(fixture_star, name):
    plan = plan_of(compared(STAR_PLANS[name](fixture_star)))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan


def test_date_filter_prunes_partitions(spark, fixture_star):
    path = os.path.join(tempfile.mkdtemp(prefix="starlane-layout-"), "fact_partitioned")
    L.write_partitioned(fixture_star, path)
    q = L.sales_between(spark, path, "2020-01-01", "2020-01-05")
    plan = plan_of(q)
    assert "PartitionFilters: [isnotnull(order_date" in plan
    got = {str(r.order_date): r.total_sales for r in q.collect()}
    assert set(got) == {"2020-01-01"}


def test_clustered_layout_sorted_within_files(spark, fixture_star):
    path = os.path.join(tempfile.mkdtemp(prefix="starlane-layout-"), "fact_clustered")
    L.write_clustered(fixture_star, path)
    df = L.read_layout(spark, path)
    assert df.count() == fixture_star.fact_sales.join(
        fixture_star.dim_orders.select("order_key", "order_date"), "order_key").count()


@pytest.mark.usefixtures("no_stored_aggregates")
def test_fact_scan_reads_only_needed_columns(fixture_star):
    plan = plan_of(compared(STAR_PLANS["category_performance"](fixture_star)))
    fact_scans = [line for line in plan.splitlines()
                  if line.startswith("ReadSchema") and "sales" in line and "product_key" in line]
    assert fact_scans, plan
    assert all("order_key" not in s and "ship_key" not in s for s in fact_scans)


def test_eager_aggregation_below_join(fixture_star):
    """K2 aggregates the fact per product before the dimension join."""
    plan = plan_of(compared(STAR_PLANS["category_performance"](fixture_star)))
    tree = plan.split("\n\n")[0]
    join_at = min(i for i, l in enumerate(tree.splitlines()) if "Join" in l)
    below = tree.splitlines()[join_at:]
    assert any("HashAggregate" in l for l in below)


def test_bucketed_layout_joins_without_fact_shuffle(spark, fixture_star):
    table = L.write_bucketed(fixture_star, "fact_sales_bucketed_test", buckets=4)
    df = spark.table(table)
    assert df.count() == fixture_star.fact_sales.join(
        fixture_star.dim_orders.select("order_key", "order_date"), "order_key").count()
    detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    assert detail.get("Num Buckets") == "4"
    assert "customer_key" in detail.get("Bucket Columns", "")
    # an aggregation on the bucket column needs no exchange
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(df.groupBy("customer_key").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("name", sorted(STAR_PLANS))
def test_single_partition_only_over_grouped_data(fixture_star, name):
    """Any move of data into one partition sits directly on an aggregate
    (grouped, bounded rows) -- never on raw fact or dimension rows."""
    lines = plan_of(compared(STAR_PLANS[name](fixture_star))).split("\n\n")[0].splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            assert "HashAggregate" in child or "TakeOrderedAndProject" in child, (name, child)


def test_preview_is_top_n_not_full_sort(fixture_star):
    plan = plan_of(L.preview(fixture_star.fact_sales, 5))
    assert "TakeOrderedAndProject" in plan
    assert len(L.preview(fixture_star.fact_sales, 5).collect()) == 5


def test_month_partitions_prune(spark, fixture_star):
    path = os.path.join(tempfile.mkdtemp(prefix="starlane-layout-"), "fact_by_month")
    L.write_partitioned(fixture_star, path, by="month")
    df = L.read_layout(spark, path)
    q = df.where("order_month = date'2020-01-01'")
    assert "PartitionFilters: [isnotnull(order_month" in plan_of(q)
    assert q.count() == df.where("order_date between date'2020-01-01' and date'2020-01-31'").count() > 0


def test_layout_overwrite_replaces_whole_table(spark, fixture_star):
    """Create-or-replace: rewriting a layout leaves no stale date folders."""
    from dataclasses import replace
    path = os.path.join(tempfile.mkdtemp(prefix="starlane-layout-"), "fact_partitioned")
    L.write_partitioned(fixture_star, path)
    fewer = replace(fixture_star, fact_sales=fixture_star.fact_sales.where("order_key = 0"))
    L.write_partitioned(fewer, path)
    back = L.read_layout(spark, path)
    assert back.count() == fewer.fact_sales.join(
        fixture_star.dim_orders.select("order_key"), "order_key").count()
