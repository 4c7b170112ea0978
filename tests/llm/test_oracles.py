"""Queries with an SQL twin equal it on the small tables."""

import duckdb
import pytest

import __spark_entry__ as E
from starlane.checks.compare import diff, duck_records
from starlane.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = E.queries()[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    problem = diff(rows, df.columns, *duck_records(con.sql(E.oracle_sql()[name])))
    assert problem is None, problem


def test_every_operator_has_one_query():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()
