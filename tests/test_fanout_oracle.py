"""Every plan on the fan-out fixture equals the naive SQL run by DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from fixtures import flat_arrow, flat_frame

from starlane.checks import duckdb_sql as D
from starlane.checks.compare import diff, duck_records
from starlane.operators import clean as C
from starlane.plans import lattice, registry
from starlane.plans.catalog import STAR_PLANS, compared


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.register("flat", flat_arrow())
    return con


def _check(df, duck, name):
    rows = [r.asDict() for r in df.collect()]
    orows, ocols = duck_records(duck.sql(D.over_flat(name)))
    problem = diff(rows, df.columns, orows, ocols)
    assert problem is None, f"{name}: {problem}"


CLEANING = {
    "impute_postal_code": lambda f: C.impute_mode(f, "postal_code"),
    "dedupe_rows": lambda f: C.dedupe_rows(C.impute_mode(f)),
    "dedupe_report": lambda f: C.dedupe_report(C.impute_mode(f)),
    "parse_dates": lambda f: C.parse_dates(C.dedupe_rows(C.impute_mode(f))),
    "invalid_date_rows": lambda f: C.invalid_date_rows(C.parse_dates(C.dedupe_rows(C.impute_mode(f)))),
    "invalid_date_count": lambda f: C.invalid_date_count(C.parse_dates(C.dedupe_rows(C.impute_mode(f)))),
    "clean_flat": C.clean_flat,
}


@pytest.mark.parametrize("name", sorted(CLEANING))
def test_cleaning(spark, duck, name):
    _check(CLEANING[name](flat_frame(spark)), duck, name)


@pytest.mark.parametrize(
    "name", ["dim_orders", "dim_shipping", "dim_customers", "dim_regions", "dim_products", "fact_sales"]
)
def test_star_tables(fixture_star, duck, name):
    _check(getattr(fixture_star, name), duck, name)


@pytest.mark.parametrize("name", sorted(STAR_PLANS))
def test_report(fixture_star, duck, name):
    _check(compared(STAR_PLANS[name](fixture_star)), duck, name)


def test_fixture_really_fans_out(fixture_star):
    """Guard: the fixture keeps repeated keys in every dimension it should."""
    for dim, key in [("dim_regions", "region_key"), ("dim_shipping", "ship_key"),
                     ("dim_products", "product_key"), ("dim_orders", "order_key"),
                     ("dim_customers", "customer_key")]:
        df = getattr(fixture_star, dim)
        assert df.count() > df.select(key).distinct().count(), dim


@pytest.fixture
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["lead_time", "mart_fulfillment", "mart_shipping", "revenue_by_state",
                                  "sales_by_month", "order_frequency_by_customer", "mart_inventory"])
def test_report_with_sort_merge_joins(fixture_star, duck, no_broadcast, name, capsys, monkeypatch):
    """Same answers when every join is a shuffle join (the plan of dimensions
    beyond every bound)."""
    monkeypatch.setattr(lattice, "BOUNDED_ROWS", -1)
    registry.release(fixture_star)
    df = compared(STAR_PLANS[name](fixture_star))
    _check(df, duck, name)
    df.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan and "InMemoryTableScan" not in plan and "report-" not in plan
