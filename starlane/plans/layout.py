"""Physical re-layouts of the fact table (S5, S6) and the mart preview.

Both layouts attach the order date to each fact row and partition files by
it, so a date filter prunes whole folders (``PartitionFilters`` in the
plan).  The clustered layout also sorts each file by the three most
filtered keys, so Parquet min/max statistics skip row groups.

The partitioned layout goes through a REBALANCE on the partition column: AQE
sizes the write tasks from real shuffle statistics, splitting a hot date across
several tasks and merging quiet ones.  The clustered layout is range-partitioned
by date and cluster keys, so the files of a hot date hold disjoint key ranges
and min/max statistics skip between files as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.functions.money import money_sum
from starlane.operators.star import Star

CLUSTER_KEYS = ["customer_key", "product_key", "region_key"]
MAX_RECORDS_PER_FILE = 5_000_000


def fact_with_order_date(star: Star, how: str = "left") -> DataFrame:
    """Fact rows with the order date of every matching order dimension row."""
    dates = star.dim_orders.select("order_key", "order_date")
    return star.fact_sales.join(dates, "order_key", how)


def _partition_column(df: DataFrame, by: str) -> tuple[DataFrame, str]:
    """Day partitions (the original layout) or month partitions, which keep
    folder counts small over long histories; filter on ``order_month`` to
    prune those."""
    if by == "day":
        return df, "order_date"
    if by == "month":
        return df.withColumn("order_month", F.trunc("order_date", "month")), "order_month"
    raise ValueError(f"unknown partition granularity {by!r}")


def write_partitioned(star: Star, path: str, by: str = "day") -> str:
    """Fact + order date (LEFT join), partitioned by order date."""
    df, part = _partition_column(fact_with_order_date(star, "left"), by)
    df = df.hint("rebalance", part)
    (df.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
       .partitionBy(part).parquet(path))
    return path


def interleaved(keys: list[str], largest: list[int]) -> Column:
    """The bits of several dense keys in turn, highest first, as one long: rows
    close in this order are close in every key.  Keys are scaled to the same
    number of bits by the ``largest`` of each."""
    bits = 63 // len(keys)
    total = F.lit(0).cast("bigint")
    for j, (key, top) in enumerate(zip(keys, largest, strict=True)):
        scaled = F.floor((F.col(key) + 1).cast("double") * ((1 << bits) - 1) / (top + 1)).cast("bigint")  # from -1 (null) on
        for i in range(bits):
            bit = F.shiftright(scaled, i).bitwiseAND(F.lit(1).cast("bigint"))
            total = total.bitwiseOR(F.shiftleft(bit, i * len(keys) + len(keys) - 1 - j))
    return total


def write_clustered(star: Star, path: str, by: str = "day", order: str = "linear") -> str:
    """Fact + order date (INNER join), partitioned by order date and
    sorted within each file by customer, product and region key.  With
    ``order="interleaved"`` the keys take turns bit by bit, so the files of a busy date
    can be skipped by product or region alone, too."""
    df, part = _partition_column(fact_with_order_date(star, "inner"), by)
    if order == "linear":
        keys = CLUSTER_KEYS
    elif order == "interleaved":
        dims = {"customer_key": star.dim_customers, "product_key": star.dim_products, "region_key": star.dim_regions}
        largest = [dims[k].agg(F.max(k)).first()[0] or 0 for k in CLUSTER_KEYS]
        df, keys = df.withColumn("_place", interleaved(CLUSTER_KEYS, largest)), ["_place"]
    else:
        raise ValueError(f"unknown cluster order {order!r}")
    df = df.repartitionByRange(part, *keys).sortWithinPartitions(part, *keys).drop("_place")
    (df.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
       .partitionBy(part).parquet(path))
    return path


def write_bucketed(star: Star, table: str, buckets: int = 64) -> str:
    """S6, catalog form: partitioned by date, bucketed and sorted by customer
    key, so joins and aggregations on customer_key read co-located buckets
    without a shuffle.  A bucket of a date is written by one task, so there
    are at most dates x buckets files."""
    bucket = F.pmod(F.hash("customer_key"), F.lit(buckets))
    df = fact_with_order_date(star, "inner").repartition("order_date", bucket)
    (df.write.mode("overwrite").partitionBy("order_date")
       .bucketBy(buckets, "customer_key").sortBy(*CLUSTER_KEYS).saveAsTable(table))
    return table


def layouts() -> dict[str, Callable[[Star, str], str]]:
    """Both layouts: name -> what writes it."""
    return {"fact_sales_partitioned": write_partitioned, "fact_sales_partitioned_clustered": write_clustered}


def write_layouts(star: Star, base: str) -> dict[str, str]:
    """Write both layouts under ``base``; returns name -> path."""
    return {name: write(star, f"{base.rstrip('/')}/{name}") for name, write in layouts().items()}


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sales_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Sales per day for [start, end] from a date-partitioned layout; only
    the matching date folders are read."""
    df = read_layout(spark, path)
    return (df.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
              .groupBy("order_date").agg(money_sum("sales").alias("total_sales")))


def preview(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first n rows of a frame in a stable order (all columns as the
    tie-break by default), as a per-partition top-n -- never a full sort."""
    return df.orderBy(*(order or df.columns)).limit(n)


MART_PREVIEW_ORDER = ["product_key", "product_name", "category", "sub_category"]
