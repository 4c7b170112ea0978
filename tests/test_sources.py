"""Flat CSV input, table writes/reads and the report registry."""

from __future__ import annotations

import os
import tempfile
from dataclasses import replace

import pytest
from fixtures import flat_frame
from pyspark.sql import functions as F

from starlane.checks.compare import diff
from starlane.plans import registry
from starlane.sources.flat import FLAT_COLUMNS, read_flat_csv, write_flat_csv
from starlane.sources.tables import read_table, read_tables, write_tables


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_flat_csv_roundtrip(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="starlane-csv-"), "flat")
    flat = flat_frame(spark)
    write_flat_csv(flat, path)
    back = read_flat_csv(spark, path)
    assert back.columns == FLAT_COLUMNS
    assert diff(_rows(back), back.columns, _rows(flat), flat.columns) is None
    header = open([os.path.join(path, f) for f in os.listdir(path) if f.endswith(".csv")][0]).readline()
    assert header.startswith("Row ID,Order ID,Order Date")


def test_write_tables_replaces(spark, fixture_star):
    base = tempfile.mkdtemp(prefix="starlane-tables-")
    where = write_tables(fixture_star.tables(), base)
    where = write_tables(fixture_star.tables(), base)  # replace, not append
    back = read_tables(spark, where)
    assert set(back) == set(fixture_star.tables())
    for name, df in back.items():
        orig = fixture_star.tables()[name]
        assert diff(_rows(df), df.columns, _rows(orig), orig.columns) is None, name


def test_registry_run_and_run_all(spark, fixture_star):
    base = tempfile.mkdtemp(prefix="starlane-reports-")
    df = registry.run(fixture_star, "aggregate_sales_by_category", base)
    assert os.path.isdir(os.path.join(base, "agg_sales_category"))
    assert df.count() > 0
    results, errors = registry.run_all(fixture_star, "marts")
    assert set(results) == set(registry.REPORTS["marts"]) and not errors


def test_run_all_keeps_going_on_errors(fixture_star):
    broken = replace(fixture_star, dim_products=fixture_star.dim_products.drop("category"))
    results, errors = registry.run_all(broken, "kpis")
    assert "product_category_performance" in errors
    assert "calculate_lead_time" in results


def test_report_row_counts(fixture_star):
    rows = registry.report_row_counts(fixture_star).collect()
    assert len(rows) == sum(len(g) for g in registry.REPORTS.values())
    assert all(r.row_count > 0 for r in rows)


def test_fetch_mart_memoised_and_rebuilt(fixture_star):
    name = "mart_inventory_analysis"
    table = registry.report_frame(fixture_star, name)
    assert registry.report_frame(fixture_star, name) is table  # built once
    a = registry.fetch_mart(fixture_star, name)
    rows = a.count()
    assert rows == table.count()
    assert dict(a.dtypes)["total_sales_revenue"] == "double"
    rebuilt = registry.rebuild_marts(fixture_star)
    assert registry.report_frame(fixture_star, name) is not table  # rebuilt
    assert rebuilt[name].count() == rows


def test_run_batch(spark):
    base = tempfile.mkdtemp(prefix="starlane-batch-")
    out = registry.run_batch(flat_frame(spark), base)
    assert not out["errors"]
    assert sum(len(v) for v in out["reports"].values()) == 13
    assert set(out["layouts"]) == {"fact_sales_partitioned", "fact_sales_partitioned_clustered"}
    assert os.path.isdir(os.path.join(base, "reports", "mart_shipping_logistics"))


def test_flat_csv_rejects_wrong_header(spark):
    import pytest
    path = os.path.join(tempfile.mkdtemp(prefix="starlane-csv-"), "bad")
    flat = flat_frame(spark).withColumnRenamed("sales", "Revenue")
    flat.write.option("header", True).csv(path)
    with pytest.raises(Exception):
        read_flat_csv(spark, path).collect()


def test_ordered_run(fixture_star):
    rows = registry.run(fixture_star, "aggregate_sales_by_category", ordered=True).collect()
    totals = [r.total_sales for r in rows]
    assert totals == sorted(totals, reverse=True)
    months = registry.run(fixture_star, "aggregate_sales_by_month", ordered=True).collect()
    keys = [(r.order_year, r.order_month) for r in months]
    assert keys == sorted(keys, key=lambda k: (k[0] is not None, k))


def test_cli_batch_from_csv_and_report(spark, capsys):
    from starlane.__main__ import main
    root = tempfile.mkdtemp(prefix="starlane-cli-")
    csv = os.path.join(root, "flat_csv")
    write_flat_csv(flat_frame(spark), csv)
    main(["batch", "--csv", csv, "--out", os.path.join(root, "out")])
    assert '"errors": {}' in capsys.readouterr().out
    main(["report", "aggregate_sales_by_category", "--out", os.path.join(root, "out"), "--ordered"])
    shown = capsys.readouterr().out
    assert "total_sales" in shown and "Tech" in shown


def test_write_tables_to_catalog_concurrently(spark, fixture_star):
    tables = {f"cat_{n}": df for n, df in fixture_star.tables().items()}
    where = write_tables(tables)              # catalog tables, written together
    where = write_tables(tables)              # and replaced
    for name, loc in where.items():
        assert spark.table(loc).count() == tables[name].count()


def test_release_deletes_the_stored_report(spark, fixture_star):
    df = registry.report_frame(fixture_star, "aggregate_sales_by_category")
    folder = os.path.dirname(df.inputFiles()[0]).removeprefix("file:")
    assert os.path.isdir(folder)
    registry.release(fixture_star)
    assert not os.path.isdir(folder)


def test_a_failed_write_leaves_the_old_table(spark):
    base = tempfile.mkdtemp(prefix="starlane-versions-")
    first = write_tables({"t": spark.range(100).toDF("x")}, base)["t"]
    half = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("bigint")).alias("x"))
    with pytest.raises(Exception, match="killed"):
        write_tables({"t": half}, base)
    assert read_table(spark, f"{base}/t").count() == 100 and read_table(spark, first).count() == 100
    assert sorted(n for n in os.listdir(f"{base}/t") if n.startswith("v-")) == [os.path.basename(first)]


def test_a_reader_keeps_its_version_and_older_ones_go(spark):
    base = tempfile.mkdtemp(prefix="starlane-versions-")
    write = lambda n: write_tables({"t": spark.range(n).toDF("x")}, base)["t"]
    write(1)
    begun = read_table(spark, f"{base}/t")
    write(2)
    assert begun.count() == 1 and read_table(spark, f"{base}/t").count() == 2
    write(3)
    assert read_table(spark, f"{base}/t").count() == 3
    assert len([n for n in os.listdir(f"{base}/t") if n.startswith("v-")]) == 2
