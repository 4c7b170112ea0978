"""Roll-ups from the stored aggregates give the reports of the naive SQL."""

from __future__ import annotations

from dataclasses import replace

import duckdb
import pytest
from conftest import SMOKE_DIR
from fixtures import flat_arrow
from test_plans import plan_of

from starlane.checks import duckdb_sql as D
from starlane.checks.compare import diff, duck_records
from starlane.plans import lattice, registry
from starlane.plans.catalog import STAR_PLANS, compared, star_for
from starlane.plans.reports import finalize

ROLLED = [
    "sales_by_month", "sales_by_product", "sales_by_category", "sales_by_subcategory", "revenue_by_state", "category_performance",
    "subcategory_performance", "avg_order_value_by_category", "order_frequency_by_customer", "mart_inventory", "sales_by_segment", "headline_kpis",
]


@pytest.fixture(scope="module")
def stars(fixture_star):
    """The fixture star without stored aggregates, and with them."""
    lattice.release(fixture_star)
    kept = replace(fixture_star, dim_orders=fixture_star.dim_orders.select("*"))  # a star of its own
    lattice.store(kept)
    yield {"from the fact": fixture_star, "stored": kept}
    lattice.release(kept)


@pytest.mark.parametrize("bitmaps", [True, False])
@pytest.mark.parametrize("state", ["from the fact", "stored"])
def test_rolled_up_reports(stars, state, bitmaps, monkeypatch):
    monkeypatch.setattr(lattice, "bitmaps_pay", lambda star, groups: bitmaps)
    con = duckdb.connect()
    con.register("flat", flat_arrow())
    star = stars[state]
    assert lattice.stored(star) == (state == "stored")
    for name in ROLLED:
        df = compared(STAR_PLANS[name](star))
        problem = diff([r.asDict() for r in df.collect()], df.columns, *duck_records(con.sql(D.over_flat(name))))
        assert problem is None, (name, problem)


def test_orders_with_several_customers_are_known(stars):
    star = stars["stored"]
    assert lattice.orders_may_share(star, "customer_key")
    assert {r.order_key for r in lattice.shared_pairs(star, "customer_key").collect()}
    alone = {r.customer_key: r._o for r in lattice.alone_by_key(star, "customer_key").collect()}
    orders = star.fact_sales.select("order_key").distinct().count()
    shared = lattice.shared_pairs(star, "customer_key").select("order_key").distinct().count()
    assert sum(alone.values()) == orders - shared


def test_bitmaps_where_they_are_full(stars, monkeypatch):
    star = stars["stored"]
    monkeypatch.setitem(lattice._COUNTS, star, {"dim_orders": 150_000, "fact_sales": 600_000})
    assert lattice.bitmaps_pay(star, 6)
    monkeypatch.setitem(lattice._COUNTS, star, {"dim_orders": 10**10, "fact_sales": 4 * 10**10})
    assert not lattice.bitmaps_pay(star, 10**4)


def fact_files(star):
    return set(star.fact_sales.inputFiles())


def test_the_fact_is_scanned_three_times_at_most(spark):
    """For each group: the two aggregates once, and what is not rolled up."""
    star = star_for(spark, SMOKE_DIR)
    lattice.store(star)
    for group, reports in registry.REPORTS.items():
        direct = [n for n, (_, plan) in reports.items() if fact_files(star) & set(finalize(plan(star)).inputFiles())]
        assert set(direct) <= set(reports) - registry.ROLLED_UP
        assert len(direct) + 2 * (group == "aggregations") <= 3


def test_reports_of_products_alone_store_no_aggregate(spark):
    star = star_for(spark, SMOKE_DIR)
    registry.release(star)
    alone = registry.report_frame(star, "avg_order_value_per_category").collect()
    assert not lattice.stored(star)
    registry.forget_reports(star)
    lattice.store(star)
    assert sorted(map(str, registry.report_frame(star, "avg_order_value_per_category").collect())) == sorted(map(str, alone))
    registry.release(star)


def test_no_row_of_the_fact_moves_by_order(spark):
    """On an order-keyed star the aggregates, and the counts per key made
    from them, need no exchange but that of the counts."""
    star = star_for(spark, SMOKE_DIR)
    lattice.release(star)
    for df in (lattice.order_products(star), lattice.order_parties(star), lattice._per_order(lattice.order_parties(star), "customer_key")):
        assert "Exchange" not in plan_of(df).split("\n\n")[0]
    lattice.store(star)
    alone = plan_of(lattice.alone_by_key(star, "region_key")).split("\n\n")[0]
    assert alone.count("Exchange") == 1
    assert not lattice.orders_may_share(star, "customer_key")
