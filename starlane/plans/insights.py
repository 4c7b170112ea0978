"""Dashboard-side summaries (C1-C15) built on the reports.

Each chart of the original dashboard post-aggregated a report table; here
each function takes that report's frame (exact decimal money, as produced
by ``plans.reports``) and adds one more lazy step, so nothing is collected
in between.  The registered queries feed them reports built once per star
and cached (``registry.report_frame``).
Shares divide by a total computed as a scalar subquery over the grouped
result (a global sum; Spark reuses the grouping shuffle), so no fact-sized
data ever moves to a single partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlane.functions.buckets import equal_width_bin, frequency_bucket
from starlane.functions.money import ratio


# Fixed values from the dashboard.
TOP_SUBCATEGORIES = 10
TOP_CUSTOMERS = 5
SAMPLE_ROWS = 100
HISTOGRAM_BINS = 20


def share_of_total(df: DataFrame, value: str, out: str, within: list[str] | None = None) -> DataFrame:
    """Add ``out`` = value / total of value (per ``within`` groups).

    The overall total is a scalar subquery: a global sum (one partial row
    per partition) evaluated once and inlined, reusing the shuffle that
    produced ``df`` -- no window moves ``df`` itself into one partition.
    Per-group totals use a window partitioned by ``within``.
    """
    if within:
        total = F.sum(value).over(Window.partitionBy(*within))
    else:
        total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, ratio(F.col(value), total))


def top_k(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """Sum ``value`` per non-null ``key`` and keep the k largest (ties: smaller
    key).  ``orderBy().limit()`` plans as a per-partition top-k, so only k
    rows per partition reach the final task."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(value))
    return sums.orderBy(F.col(value).desc(), F.col(key).asc()).limit(k)


def category_revenue_share(m1: DataFrame) -> DataFrame:
    """Revenue and revenue share per category, from M1."""
    by_cat = m1.groupBy("category").agg(
        F.sum("total_sales_revenue").alias("total_sales_revenue")
    )
    return share_of_total(by_cat, "total_sales_revenue", "revenue_share")


def top_subcategories_by_orders(m1: DataFrame) -> DataFrame:
    """Top 10 sub-categories by summed per-product distinct orders (M1)."""
    return top_k(m1, "sub_category", "total_orders", TOP_SUBCATEGORIES)


def sales_by_region(m2: DataFrame) -> DataFrame:
    """Total sales per region, from M2."""
    return m2.groupBy("region_name").agg(F.sum("total_sales").alias("total_sales"))


def top_customers_share(m2: DataFrame) -> DataFrame:
    """C4: top 5 customers by sales (M2) with their share within the five."""
    top = top_k(m2, "customer_name", "total_sales", TOP_CUSTOMERS)
    return share_of_total(top, "total_sales", "sales_share")


def shipping_sample(m3: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """A deterministic n-row sample of M3, ordered by order id as text.

    Rows are ranked by the md5 of their grain columns and the n smallest are
    kept -- a per-partition top-n, so the sample never needs the whole mart
    in one place.  Fewer than n rows -> all of them.
    """
    grain = ["order_id", "customer_id", "customer_name", "region_name", "ship_mode"]
    digest = F.md5(
        F.concat_ws("|", F.col("order_key").cast("string"), *[F.coalesce(F.col(c), F.lit("")) for c in grain])
    )
    picked = m3.withColumn("_h", digest).orderBy("_h").limit(n)
    return picked.orderBy(F.col("order_id").cast("string"), "_h").drop("_h")


def shipping_days_by_mode(m3: DataFrame) -> DataFrame:
    """Per ship mode, the stacked (summed) and the mean per-order
    average shipping days from M3."""
    return m3.groupBy("ship_mode").agg(
        F.sum("avg_shipping_days").alias("sum_shipping_days"),
        F.avg("avg_shipping_days").alias("avg_shipping_days"),
    )


def region_sales_share(m3: DataFrame) -> DataFrame:
    """Sales and sales share per region, from M3."""
    by_region = m3.groupBy("region_name").agg(F.sum("total_sales").alias("total_sales"))
    return share_of_total(by_region, "total_sales", "sales_share")


def _performance_by_category(k2: DataFrame, k3: DataFrame) -> DataFrame:
    k2 = k2.select(
        F.lit("category_performance").alias("source"), "category", "total_sales", "total_revenue")
    k3 = k3.select(
        F.lit("subcategory_performance").alias("source"), "category", "total_sales", "total_revenue")
    return k2.unionByName(k3)


def category_line_count(k2: DataFrame, k3: DataFrame) -> DataFrame:
    """Line count per category over K2 and over K3."""
    return _performance_by_category(k2, k3).groupBy("source", "category").agg(
        F.sum("total_sales").alias("total_sales"))


def category_performance_share(k2: DataFrame, k3: DataFrame) -> DataFrame:
    """Revenue share per category over K2 and over K3."""
    by_cat = _performance_by_category(k2, k3).groupBy("source", "category").agg(
        F.sum("total_revenue").alias("total_revenue"))
    return share_of_total(by_cat, "total_revenue", "revenue_share", within=["source"])


def lead_time_histogram(k1: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """C11: counts of K1 lead times in ``bins`` equal-width bins over [min, max].

    The fact-sized K1 is reduced to one row per distinct day count (a domain
    bounded by the calendar span) by a distributed aggregation; min and max
    are scalar subqueries over that small frame, binning is a projection.
    """
    counts = (k1.where(F.col("lead_time_days").isNotNull())
              .groupBy("lead_time_days").agg(F.count(F.lit(1)).alias("_n")))
    bounds = counts.agg(F.struct(F.min("lead_time_days").alias("lo"),
                                 F.max("lead_time_days").alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    binned = counts.select(
        "_n",
        equal_width_bin("lead_time_days", lo, hi, bins).alias("bin"),
        lo.cast("double").alias("_lo"),
        (hi.cast("double") - lo.cast("double")).alias("_width"),
    )
    return binned.groupBy("bin", "_lo", "_width").agg(F.sum("_n").alias("lead_time_count")).select(
        "bin",
        (F.col("_lo") + (F.col("bin") - 1).cast("double") * F.col("_width") / float(bins)).alias("bin_start"),
        (F.col("_lo") + F.col("bin").cast("double") * F.col("_width") / float(bins)).alias("bin_end"),
        "lead_time_count",
    )


def frequency_buckets(k5: DataFrame) -> DataFrame:
    """Customers per order-frequency bucket, most frequent first.

    Bucket edges are decided on the exact ratio."""
    counted = k5.groupBy(frequency_bucket("avg_order_frequency").alias("frequency_range")).agg(
        F.count(F.lit(1)).alias("customers"))
    return counted.orderBy(F.col("customers").desc(), "frequency_range")


def sales_by_year(a1: DataFrame) -> DataFrame:
    """A1's monthly sales rolled up per year."""
    return a1.groupBy("order_year").agg(F.sum("total_sales").alias("total_sales"))


def orders_by_year(a1: DataFrame) -> DataFrame:
    """C14: A1's monthly distinct orders summed per year (an order spanning
    two months counts twice, as the stacked bars do)."""
    return a1.groupBy("order_year").agg(F.sum("total_orders").alias("total_orders"))


def state_revenue_share(a5: DataFrame) -> DataFrame:
    """Revenue share per state, from A5."""
    return share_of_total(a5, "total_revenue", "revenue_share")
