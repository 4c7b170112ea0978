"""Every registered query equals its DuckDB twin on the sf0.001 tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from conftest import SMOKE_DIR

import __spark_entry__ as E
from starlane.checks.compare import diff, duck_records
from starlane.plans.catalog import QUERIES

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMOKE_DIR)
    rows = [r.asDict() for r in df.collect()]
    orows, ocols = duck_records(duck.sql(E.oracle_sql()[name]))
    problem = diff(rows, df.columns, orows, ocols)
    assert problem is None, problem


@pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="test tables not present")
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns
