"""Shuffle files, fact exchanges and stored aggregates: no more than a query needs."""

from __future__ import annotations

import re
import time

from conftest import SMOKE_DIR
from fixtures import flat_frame
from test_plans import plan_of

from starlane.operators import star as S
from starlane.operators.clean import clean_flat
from starlane.plans import catalog, lattice, registry
from starlane.session import SHUFFLE_CLEANUP, brief_shuffles, write_table


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_their_query(spark):
    def left(step):
        before = _shuffle_files(spark)
        df = spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count()
        step(df)
        until = time.time() + 20
        while time.time() < until and _shuffle_files(spark) - before:
            time.sleep(0.2)
        return _shuffle_files(spark) - before

    def written(df):
        with brief_shuffles(spark):
            write_table(df, "brief")
    assert not left(written)
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_star_and_reports_are_built_with_brief_shuffles(spark, monkeypatch):
    seen = []
    clean, plan = catalog.C.clean_parts, registry.R.finalize
    monkeypatch.setattr(catalog, "_STARS", {})
    monkeypatch.setattr(catalog.C, "clean_parts", lambda *a, **k: seen.append(spark.conf.get(SHUFFLE_CLEANUP)) or clean(*a, **k))
    monkeypatch.setattr(registry.R, "finalize", lambda df: seen.append(spark.conf.get(SHUFFLE_CLEANUP)) or plan(df))
    star = catalog.star_for(spark, SMOKE_DIR)
    registry.run_all(star, "kpis")
    assert seen == ["true"] * 6 and spark.conf.get(SHUFFLE_CLEANUP) == "false"
    registry.release(star)


def test_small_key_maps_move_no_fact_row(spark):
    """Though nothing is broadcast by the size of the table that holds all maps."""
    rows = S.distinct_dimensions(clean_flat(flat_frame(spark)))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        tree = plan_of(S.build_fact(clean_flat(flat_frame(spark)), S.key_maps(rows)))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert not re.findall(r"Exchange hashpartitioning\((?:ship_date|postal_code)#", tree)


def test_keys_above_the_bound_are_not_broadcast(spark, monkeypatch):
    from starlane.operators import keys
    rows = S.distinct_dimensions(clean_flat(flat_frame(spark)))
    clean = clean_flat(flat_frame(spark))
    small = {tuple(r) for r in S.build_fact(clean, S.key_maps(rows)).collect()}
    monkeypatch.setattr(keys, "BOUNDED_KEYS", -1)
    maps = S.key_maps(rows)
    assert not any("ResolvedHint" in m._jdf.queryExecution().analyzed().toString() for m in maps.values())
    assert {tuple(r) for r in S.build_fact(clean, maps).collect()} == small


def test_reports_store_only_the_aggregate_they_read(spark):
    star = catalog.star_for(spark, SMOKE_DIR)
    registry.release(star)
    registry.report_frame(star, "aggregate_sales_by_month")
    assert lattice.stored(star, "order_parties") and not lattice.stored(star, "order_products")
    registry.report_frame(star, "mart_inventory_analysis")
    assert lattice.stored(star)
    registry.release(star)
    assert not lattice.stored(star, "order_parties")


def test_sums_per_product_are_made_once(spark):
    star = catalog.star_for(spark, SMOKE_DIR)
    registry.release(star)
    plain = {tuple(r) for r in lattice.per_product(star).select("product_key", "_o", "_s", "_n", "_ns").collect()}
    lattice.store(star, "order_products")
    held = lattice.per_product(star)
    assert {tuple(r) for r in held.select("product_key", "_o", "_s", "_n", "_ns").collect()} == plain
    for name in ("sales_by_product", "mart_inventory", "category_performance", "subcategory_performance", "avg_order_value_by_category"):
        assert set(held.inputFiles()) <= set(catalog.STAR_PLANS[name](star).inputFiles())
        assert not set(lattice.order_products(star).inputFiles()) & set(catalog.STAR_PLANS[name](star).inputFiles())
    registry.release(star)
