"""Money without cuts, CSV as other programs write it, and batches that account
for every row."""

from __future__ import annotations

import csv
import glob
import shutil
from dataclasses import replace
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from fixtures import ROWS, flat_frame
from pyspark.sql import functions as F

from starlane.functions.money import money
from starlane.operators import clean as C
from starlane.operators.star import build_star
from starlane.plans import catalog, registry
from starlane.plans import layout as L
from starlane.plans import reports as R
from starlane.session import ensure_checkpoint_dir
from starlane.sources.flat import CSV_HEADER, read_flat_csv


def with_sales(sales):
    row = next(r for r in ROWS if r[0] == 4)
    return [(100 + i, f"Z{i}", *row[2:17], s) for i, s in enumerate(sales)]


def test_small_and_large_sales_are_summed_exactly(spark):
    sales = [0.004, 0.004, 0.0041, 0.000125, 2e10, 12345678901.2345, 0.1, 0.2]
    star = build_star(C.clean_flat(flat_frame(spark, with_sales(sales))))
    want = sum(Fraction(repr(s)) for s in sales)
    total = R.sales_by_category(star).first().total_sales
    assert Fraction(str(total)) == want
    assert R.finalize(R.category_performance(star)).first().avg_revenue_per_sale == float(want) / len(sales)
    assert Fraction(str(R.mart_inventory(star).agg(F.sum("total_sales_revenue")).first()[0])) == want


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_money_that_does_not_fit_stops_the_job(spark, ansi):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="does not fit"):
            spark.createDataFrame([(1e15,)], "x double").select(money("x")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_averages_are_not_rounded(spark):
    star = build_star(C.clean_flat(flat_frame(spark, with_sales([1.0, 1.0, 2.0]))))
    assert R.avg_order_value_by_category(star).first().avg_order_value == 4 / 3


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(CSV_HEADER)
        writer.writerows(rows)


def test_csv_of_another_writer(spark, tmp_path):
    base = list(ROWS[0])
    names = ['Storage 3 1/2" Pages', 'Avery Binder, 3" Capacity, Black', '"quoted"', "back\\slash", "plain", "comma, only"]
    rows = [[i, *base[1:16], n, 1.5] for i, n in enumerate(names)]
    write_csv(tmp_path / "flat.csv", rows)
    got = read_flat_csv(spark, str(tmp_path / "flat.csv")).orderBy("row_id").collect()
    assert [r.product_name for r in got] == names
    assert [r.sales for r in got] == [1.5] * len(names)
    rows.append([99, *base[1:16], 'two\nlines, "in" one', 2.5])
    write_csv(tmp_path / "lines.csv", rows)
    got = read_flat_csv(spark, str(tmp_path / "lines.csv"), multi_line=True).filter("row_id = 99").collect()
    assert [r.product_name for r in got] == ['two\nlines, "in" one']


def test_csv_null_tokens_and_wrong_numbers(spark, tmp_path):
    base = list(ROWS[0])
    rows = [[1, *base[1:12], "NA", *base[13:16], "N/A", 1], [2, *base[1:12], "", *base[13:16], "null", 2], [3, *base[1:12], "12", *base[13:16], "Nano", 3]]
    write_csv(tmp_path / "a.csv", rows)
    got = read_flat_csv(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()
    assert [(r.postal_code, r.product_name) for r in got] == [(None, None), (None, None), (12.0, "Nano")]
    kept = read_flat_csv(spark, str(tmp_path / "a.csv"), null_tokens=()).filter("row_id = 3").select("product_name")
    assert kept.first()[0] == "Nano"
    write_csv(tmp_path / "b.csv", [[1, *base[1:12], "x1", *base[13:]]])
    with pytest.raises(Exception, match="not a number"):
        read_flat_csv(spark, str(tmp_path / "b.csv")).collect()


def test_text_postal_codes_keep_their_type(spark):
    df = spark.createDataFrame([("02134",), ("02134",), ("10001",), (None,)], "postal_code string")
    assert sorted(r[0] for r in C.impute_mode(df).collect()) == ["02134", "02134", "02134", "10001"]


def test_lenient_batch_accounts_for_every_row(spark, tmp_path):
    bad = (50, "O9", "31/02/2020", *ROWS[0][3:])
    out = registry.run_batch(flat_frame(spark, [*ROWS, bad]), str(tmp_path), strict=False)
    rows = out["rows"]
    assert rows == {"rows_in": 14, "duplicates_removed": 1, "quarantined": 1, "lines": 12, "invalid_dates": 2}
    assert rows["rows_in"] == rows["duplicates_removed"] + rows["quarantined"] + rows["lines"]
    set_aside = spark.read.parquet(out["quarantine"]).collect()
    assert [(r.row_id, r.order_date_s) for r in set_aside] == [(50, "31/02/2020")]
    with pytest.raises(Exception):
        registry.run_batch(flat_frame(spark, [*ROWS, bad]), str(tmp_path / "strict"))


def test_run_all_reports_what_fails_while_it_runs(spark, fixture_star):
    broken = replace(fixture_star, fact_sales=fixture_star.fact_sales.withColumn("sales", F.lit(1e16)))
    results, errors = registry.run_all(broken, "kpis")
    assert "does not fit" in errors["product_category_performance"]
    assert "calculate_lead_time" in results


def test_star_is_rebuilt_when_its_input_changes(spark, tmp_path):
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "in")
    (tmp_path / "in").chmod(0o755)
    first = catalog.star_for(spark, str(tmp_path / "in"))
    assert catalog.star_for(spark, str(tmp_path / "in")) is first
    path = tmp_path / "in" / "lineitem.parquet"
    table = pq.read_table(path).slice(0, 3000)
    path.unlink()
    pq.write_table(table, path)
    again = catalog.star_for(spark, str(tmp_path / "in"))
    assert again is not first
    assert 0 < again.fact_sales.count() <= 3000


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_files_of_a_hot_date_hold_disjoint_key_ranges(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.lit(1.0).alias("sales"), F.lit(0).cast("long").alias("order_key"), F.lit(0).cast("long").alias("ship_key"),
        (F.col("id") * 7919 % 1000).alias("customer_key"), F.lit(0).cast("long").alias("region_key"), F.col("id").alias("product_key"),
    )
    orders = spark.sql("SELECT 'a' AS order_id, DATE'2020-01-01' AS order_date, 0L AS order_key")
    star = replace(_star_of(spark), fact_sales=rows, dim_orders=orders)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = L.write_clustered(star, str(tmp_path / "clustered"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    spans = []
    for f in glob.glob(f"{path}/order_date=2020-01-01/*.parquet"):
        keys = pq.read_table(f, columns=["customer_key"]).column(0).to_pylist()
        spans.append((min(keys), max(keys)))
    spans.sort()
    assert len(spans) > 2
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_bucketed_files_are_bounded(spark):
    star = catalog.star_for(spark, "/root/testdata/sf0.001")
    days = L.fact_with_order_date(star, "inner").select("order_date").distinct().count()
    L.write_bucketed(star, "bounded_buckets", buckets=4)
    assert len(spark.table("bounded_buckets").inputFiles()) <= 4 * days


def _star_of(spark):
    return catalog.star_for(spark, "/root/testdata/sf0.001")


def test_a_batch_goes_on_where_it_failed(spark, tmp_path, monkeypatch):
    """A failing layout leaves the star and the reports done; a second run over the
    same input builds neither again, and a changed input starts anew."""
    from starlane.operators import clean
    from starlane.plans import layout

    source, out = str(tmp_path / "flat"), str(tmp_path / "out")
    flat_frame(spark).write.parquet(source)
    read = lambda: spark.read.parquet(source)

    def broken(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(layout, "write_clustered", broken)
        with pytest.raises(OSError, match="disk full"):
            registry.run_batch(read(), out)
    with monkeypatch.context() as m:
        for module, name in ((clean, "clean_parts"), (layout, "write_partitioned"), (registry.lattice, "store"), (registry.R, "finalize")):
            m.setattr(module, name, broken)
        done = registry.run_batch(read(), out)
    assert not done["errors"] and sum(map(len, done["reports"].values())) == 13 and len(done["layouts"]) == 2
    assert done["rows"]["lines"] == 12
    star = registry._open_star(spark, registry.Steps(spark, out, registry.batch_state(read())).done["star"])
    assert star.keyed and star.fact_sales.count() == spark.read.parquet(done["tables"]["fact_sales"]).count()
    plan = star.fact_sales.groupBy("order_key").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]
    flat_frame(spark, ROWS[:6]).write.mode("append").parquet(source)
    assert registry.batch_state(read()) != registry.Steps(spark, out, "").state
    assert registry.run_batch(read(), out)["rows"]["rows_in"] == 19
