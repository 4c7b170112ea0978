"""A hot key (a third of all lines on one order) is split by AQE in the
shuffle joins and results stay exact."""

from __future__ import annotations

import contextlib
import io

import duckdb
import pytest
from fixtures import ROWS, flat_arrow, flat_frame

from starlane.checks import duckdb_sql as D
from starlane.checks.compare import diff, duck_records
from starlane.operators.clean import clean_flat
from starlane.operators.star import build_star
from starlane.plans.catalog import STAR_PLANS, compared


def _hot_rows():
    base = [r for r in ROWS]
    hot = []
    for i in range(2 * len(base) * 40):
        r = list(base[i % len(base)])
        r[0] = 1000 + i            # new row id
        r[1] = "HOT"               # one order holds most lines
        r[13] = f"P{i % 500}"      # many products
        r[17] = round(1 + (i % 97) * 0.37, 2)
        hot.append(tuple(r))
    return base + hot


@pytest.fixture
def skew_conf(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["mart_fulfillment", "lead_time"])
def test_hot_order_split_and_exact(spark, skew_conf, name):
    rows = _hot_rows()
    star = build_star(clean_flat(flat_frame(spark, rows))).written()
    df = compared(STAR_PLANS[name](star))
    got = [r.asDict() for r in df.collect()]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    final = buf.getvalue().split("== Initial Plan ==")[0]
    assert "isSkewJoin=true" in final or "skew=true" in final, final
    con = duckdb.connect()
    con.register("flat", flat_arrow(rows))
    orows, ocols = duck_records(con.sql(D.over_flat(name)))
    assert diff(got, df.columns, orows, ocols) is None
