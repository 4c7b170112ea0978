"""Partitions follow the size of the input, and reports move no more rows than they must."""

from __future__ import annotations

import pytest
from fixtures import ROWS, flat_frame
from pyspark.sql import functions as F
from test_plans import plan_of

from starlane import session
from starlane.operators import clean as C
from starlane.plans import catalog, reports
from starlane.sources.tables import write_keyed

SMOKE_DIR = "/root/testdata/sf0.001"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def sized(spark):
    """The session as it was, afterwards."""
    before = spark.conf.get(ADVISORY)
    yield spark
    spark.conf.unset(session.INITIAL_PARTITIONS)
    spark.conf.set(ADVISORY, before)


def test_buckets_grow_with_the_input(sized, tmp_path):
    session.size_shuffles(sized, 1)
    assert session.shuffle_partitions(sized) == 8  # what the session has is enough
    session.size_shuffles(sized, 20 * session.PARTITION_BYTES)
    session.size_shuffles(sized, 3 * session.PARTITION_BYTES)  # never fewer
    assert session.shuffle_partitions(sized) == 20
    rows = sized.range(2000).select(F.col("id").alias("k"))
    table = write_keyed(rows, "starlane_sizing_test", str(tmp_path / "t"), "k")
    assert len(table.inputFiles()) == 20
    sized.sql("DROP TABLE starlane_sizing_test")


def test_the_source_sizes_the_shuffles(sized, monkeypatch):
    files = [f"{SMOKE_DIR}/{t}.parquet" for t in catalog.STANDIN_TABLES]
    monkeypatch.setattr(session, "PARTITION_BYTES", session.input_bytes(sized, files) // 30)
    flat = catalog.standin_flat(sized, SMOKE_DIR)
    assert session.shuffle_partitions(sized) >= 30
    assert flat.count() > 0


def test_merged_partitions_are_bounded_however_many_there_are(sized):
    sized.conf.set(ADVISORY, "128MB")
    session.size_shuffles(sized, 1)  # the session has partitions enough
    assert session.shuffle_partitions(sized) == 8
    assert sized.conf.get(ADVISORY) == session.MERGED
    sized.conf.set(ADVISORY, "4m")
    session.size_shuffles(sized, 20 * session.PARTITION_BYTES)  # never larger
    assert sized.conf.get(ADVISORY) == "4m"


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _exchanges_above(plan, scan):
    """Exchanges between the result and the scan of a table."""
    lines = plan.split("\n\n")[0].split("== Initial Plan ==")[0].splitlines()
    at = next(i for i, line in enumerate(lines) if scan in line)
    depth, found = lines[at].find("Scan"), 0
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-*|"))
        if line.strip() and here < depth:
            depth = here
            found += "Exchange hashpartitioning" in line or line.lstrip(" :+-*").startswith("Exchange")
    return found


def test_marts_group_where_their_last_join_left_the_rows(spark, shuffled):
    """No exchange follows the join with the customers."""
    star = catalog.star_for(spark, SMOKE_DIR)
    for plan, most in ((reports.mart_shipping, 1), (reports.mart_fulfillment, 2), (reports.lead_time, 1)):
        tree = plan_of(plan(star))
        assert _exchanges_above(tree, "fact_sales") <= most, tree


def test_lenient_cleaning_keeps_both_parts(spark):
    """One staged table holds lines and set-aside rows, each with its columns."""
    flat = flat_frame(spark, [*ROWS, *ROWS[:3]])
    bad = flat.withColumn("order_date_s", F.when(F.col("row_id") % 2 == 0, F.lit("31/02/1995")).otherwise(F.col("order_date_s")))
    done = C.clean_parts(bad, strict=False)
    good, aside = C.quarantine_dates(C.parse_dates(C.dedupe_rows(C.impute_mode(bad)), strict=False))
    rows = lambda df: sorted(map(str, df.collect()))
    assert len(done.paths) == 1
    assert done.lines.columns == good.drop("row_id").columns and rows(done.lines) == rows(good.drop("row_id"))
    assert done.quarantined.columns == aside.columns and rows(done.quarantined) == rows(aside)
    counts = done.report()
    assert counts["rows_in"] == counts["duplicates_removed"] + counts["quarantined"] + counts["lines"]
    done.release()
