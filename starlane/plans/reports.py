"""Sales aggregates (A1-A5), KPIs (K1-K5), data marts (M1-M3) and the
advertised extras (X1-X3), as DataFrame plans over a ``Star``.

Semantics follow the warehouse SQL these reports were defined in: every
dimension is LEFT joined on its surrogate key (M1 inner), and because a key
can repeat across dimension rows, a join multiplies fact rows.  SUM and
COUNT see those copies, COUNT DISTINCT and MIN/MAX do not.

The plans do not materialise that fan-out.  Three rewrites keep results
identical while moving less data:

* eager aggregation -- the fact is aggregated to the grain of the join keys
  (map-side partial aggregation first) before it meets a dimension;
* stored roll-ups -- reports at the grain of orders or products are rolled up
  from the aggregates of ``plans.lattice``;
* weighted dimensions -- a dimension is reduced to
  ``(key, reported attributes, copies)`` and ``copies`` multiplies sums and
  counts instead of repeating rows.

Money stays ``decimal`` here (exact, order-independent sums); ``finalize``
turns it into double for output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlane.functions.dates import days_between
from starlane.functions.money import money, money_avg, money_sum, ratio, round_half_away
from starlane.operators.star import Star
from starlane.plans import lattice


_DIM_OF_KEY = {
    "order_key": "dim_orders", "ship_key": "dim_shipping", "customer_key": "dim_customers",
    "region_key": "dim_regions", "product_key": "dim_products",
}


def _one():
    return F.lit(1)


def finalize(df: DataFrame) -> DataFrame:
    """Output form of a report: exact decimal money cast to double, internal
    columns (leading underscore) dropped."""
    return df.select(
        [
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
            if not f.name.startswith("_")
        ]
    )


def weighted_dim(dim: DataFrame, key: str, attrs: list[str], star_dim: bool = False) -> DataFrame:
    """Reduce a dimension to its distinct (key, attrs) with the number of
    dimension rows behind each, which is how often a LEFT join on ``key``
    would repeat a fact row into that group.

    ``star_dim`` says ``dim`` is a star dimension table itself, which is
    distinct on all its columns (D1-D5): when (key, attrs) is every column,
    each weight is 1 and no aggregation -- no shuffle of a possibly
    order-sized dimension -- is needed.
    """
    if star_dim and {key, *attrs} == set(dim.columns):
        return dim.select(key, *attrs, F.lit(1).cast("bigint").alias("_w"))
    return dim.groupBy(key, *attrs).agg(F.count(_one()).alias("_w"))


def _w(col: str = "_w"):
    # An unmatched LEFT join contributes one row with null attributes.
    return F.coalesce(F.col(col), F.lit(1).cast("bigint"))


def _by_product_attribute(star: Star, dim: DataFrame, attrs: list[str]) -> DataFrame:
    """SUM(sales) and COUNT(DISTINCT order_key) per product attributes.

    Orders and products meet the weighted dimension directly (a broadcast when
    AQE measures it small); an order has several products, so its distinct
    count is by bitmaps or by pairs, whichever takes less (``plans.lattice``).
    """
    wd = weighted_dim(dim, "product_key", attrs)
    joined = lattice.order_products(star).select("product_key", "order_key", "_s").join(wd, "product_key", "left")
    rows = joined.select(*attrs, "order_key", (F.col("_s") * _w()).alias("_s"))
    bitmaps = lattice.bitmaps_pay(star, dim.select(*attrs).distinct().count() + 1)
    return lattice.distinct_orders(rows, attrs, bitmaps)


def _by_party_attribute(star: Star, dim: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """SUM(sales) and COUNT(DISTINCT order_key) per attributes of a dimension of
    which nearly every order has one key: such orders are summed and counted per
    key, inside their bucket, before they meet the dimension."""
    wd = weighted_dim(dim, key, attrs)
    alone = lattice.alone_by_key(star, key).join(wd, key, "left")
    out = alone.groupBy(*attrs).agg(F.sum(F.col("_s") * _w()).alias("_s"), F.sum("_o").alias("_o"))
    if not lattice.orders_may_share(star, key):
        return out
    shared = lattice.shared_pairs(star, key).join(wd, key, "left")
    rows = shared.select(*attrs, "order_key", (F.col("_s") * _w()).alias("_s"))
    both = out.unionByName(lattice.distinct_orders(rows, attrs, bitmaps=False))
    return both.groupBy(*attrs).agg(F.sum("_s").alias("_s"), F.sum("_o").alias("_o"))


def _per_order(star: Star) -> DataFrame:
    return lattice.order_parties(star).groupBy("order_key").agg(F.sum("_s").alias("_s"))


def _orders_per_product(star: Star) -> DataFrame:
    """Sales and distinct orders per product key: a row of the roll-up is one of both."""
    return lattice.per_product(star).select("product_key", "_s", "_o")


# ---------------------------------------------------------------- A1-A5

def sales_by_month(star: Star) -> DataFrame:
    """A1: sales and distinct orders per order year/month."""
    dates = star.dim_orders.select(
        "order_key",
        F.year("order_date").cast("bigint").alias("order_year"),
        F.month("order_date").cast("bigint").alias("order_month"),
    )
    per_order = _per_order(star)
    if not star.keyed:  # one exchange on order_key serves both the grouping and the join
        dates = dates.repartition("order_key")
    months = weighted_dim(dates, "order_key", ["order_year", "order_month"])
    joined = per_order.join(months, "order_key", "left")
    return joined.groupBy("order_year", "order_month").agg(
        F.sum(F.col("_s") * _w()).alias("total_sales"),
        F.count(_one()).alias("total_orders"),
    )


def sales_by_product(star: Star) -> DataFrame:
    """A2: sales and distinct orders per product key and description."""
    per_key = _orders_per_product(star)
    attrs = ["product_name", "category", "sub_category"]
    dim = weighted_dim(star.dim_products, "product_key", ["product_id", *attrs], star_dim=True)
    joined = per_key.join(dim, "product_key", "left")
    return joined.groupBy("product_key", *attrs).agg(
        F.sum(F.col("_s") * _w()).alias("total_sales"),
        F.max("_o").alias("total_orders"),
    )


def sales_by_category(star: Star) -> DataFrame:
    """A3: sales and distinct orders per category."""
    out = _by_product_attribute(star, star.dim_products, ["category"])
    return out.select("category", F.col("_s").alias("total_sales"), F.col("_o").alias("total_orders"))


def sales_by_subcategory(star: Star) -> DataFrame:
    """A4: sales and distinct orders per sub-category (named ``subcategory``)."""
    dim = star.dim_products.withColumnRenamed("sub_category", "subcategory")
    out = _by_product_attribute(star, dim, ["subcategory"])
    return out.select("subcategory", F.col("_s").alias("total_sales"), F.col("_o").alias("total_orders"))


def revenue_by_state(star: Star) -> DataFrame:
    """A5: revenue and distinct orders per state (reported as ``region``)."""
    dim = star.dim_regions.select("region_key", F.col("state").alias("region"))
    out = _by_party_attribute(star, dim, "region_key", ["region"])
    return out.select("region", F.col("_s").alias("total_revenue"), F.col("_o").alias("total_orders"))


# ---------------------------------------------------------------- K1-K5

def lead_time(star: Star) -> DataFrame:
    """K1: days from an order's first order date to its last ship date, per
    (order, product).

    The ship and product dimensions are reduced to unique key -> value maps
    first (ship_key -> ship date, product_key -> product id).  The order
    dimension is joined as it is: MIN and MAX do not mind its copies, and a
    grouping of it would be an order-sized shuffle of its own.  On an order-keyed
    star that join and the grouping stay inside the buckets.  Rows are grouped by
    product key, which stands for one product id, so the ids come last, to the
    finished rows.
    """
    ship = star.dim_shipping.groupBy("ship_key").agg(F.max("ship_date").alias("_ship_date"))
    products = star.dim_products.select("product_key", "product_id").distinct()
    orders = star.dim_orders.select("order_key", "order_id", F.col("order_date").alias("_order_date"))
    joined = (
        star.fact_sales.select("order_key", "product_key", "ship_key")
        .join(lattice.bounded(star, ship, "dim_shipping"), "ship_key", "left")
        .join(orders, "order_key", "left")
    )
    days = joined.groupBy("order_key", "order_id", "product_key").agg(
        days_between(F.max("_ship_date"), F.min("_order_date")).alias("lead_time_days")
    )
    return days.join(products, "product_key", "left").select("order_key", "order_id", "product_id", "lead_time_days")


def _per_product(star: Star) -> DataFrame:
    if lattice.stored(star, "order_products"):
        return lattice.per_product(star).select("product_key", "_n", "_s", "_ns")
    return star.fact_sales.groupBy("product_key").agg(
        F.count(_one()).alias("_n"),
        money_sum("sales").alias("_s"),
        F.count("sales").alias("_ns"),
    )


def _product_performance(star: Star, attrs: list[str]) -> DataFrame:
    joined = _per_product(star).join(
        weighted_dim(star.dim_products, "product_key", attrs), "product_key", "left"
    )
    agg = joined.groupBy(*attrs).agg(
        F.sum(F.col("_n") * _w()).alias("total_sales"),
        F.sum(F.col("_s") * _w()).alias("total_revenue"),
        F.sum(F.col("_ns") * _w()).alias("_ns"),
    )
    return agg.select(
        *attrs, "total_sales", "total_revenue",
        money_avg("total_revenue", "_ns").alias("avg_revenue_per_sale"),
    )


def category_performance(star: Star) -> DataFrame:
    """K2: line count (``total_sales``), revenue and average line value per
    category.  The fact is pre-aggregated per product key first, so only one
    partial row per product and partition crosses the shuffle."""
    return _product_performance(star, ["category"])


def subcategory_performance(star: Star) -> DataFrame:
    """K3: as K2 per (category, sub-category)."""
    return _product_performance(star, ["category", "sub_category"])


def avg_order_value_by_category(star: Star) -> DataFrame:
    """K4: average line value per category."""
    joined = _per_product(star).join(
        weighted_dim(star.dim_products, "product_key", ["category"]), "product_key", "left"
    )
    agg = joined.groupBy("category").agg(
        F.sum(F.col("_s") * _w()).alias("_s"), F.sum(F.col("_ns") * _w()).alias("_ns")
    )
    return agg.select("category", money_avg("_s", "_ns").alias("avg_order_value"))


def order_frequency_by_customer(star: Star) -> DataFrame:
    """K5: distinct orders / distinct order dates per customer name.

    Dimension copies do not matter to distinct counts.  Orders of one customer
    key are counted per key, and the key's order dates kept as a set (bounded
    by the calendar), inside the order buckets; keys then meet their names, and
    sets and counts merge per name.  Orders with several customer keys are made
    distinct per name.  A zero divisor gives null.
    """
    key = "customer_key"
    parties = lattice.order_parties(star).groupBy("order_key", key).agg(F.count(_one()).alias("_rows"))
    keys = parties.groupBy("order_key").agg(F.count(_one()).alias("_k"))
    dates = star.dim_orders.groupBy("order_key").agg(F.collect_set("order_date").alias("_dates"))
    pairs = parties.join(keys, "order_key").join(dates, "order_key", "left")

    def merged(rows: DataFrame, by: str, orders) -> DataFrame:
        """Orders and the set of dates of each ``by``; a row's orders go with its first date."""
        one = rows.select(by, orders.alias("_o"), F.posexplode_outer("_dates").alias("_at", "_date"))
        first = F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_o"))
        return one.groupBy(by).agg(F.sum(first).alias("_o"), F.collect_set("_date").alias("_dates"))

    names = star.dim_customers.select(key, "customer_name").distinct()
    per_key = merged(pairs, key, (F.col("_k") == 1).cast("bigint"))
    out = merged(per_key.join(names, key, "left"), "customer_name", F.col("_o"))
    out = out.select("customer_name", "_o", F.size("_dates").cast("bigint").alias("_d"))
    if lattice.orders_may_share(star, key):
        shared = lattice.shared_pairs(star, key).join(names, key, "left").select("customer_name", "order_key").distinct()
        counts = shared.groupBy("customer_name").agg(F.count(_one()).alias("_o"))
        both = out.unionByName(counts.withColumn("_d", F.lit(0).cast("bigint")))
        out = both.groupBy("customer_name").agg(F.sum("_o").alias("_o"), F.max("_d").alias("_d"))
    return out.select("customer_name", ratio("_o", "_d").alias("avg_order_frequency"))


# ---------------------------------------------------------------- M1-M3

def mart_inventory(star: Star) -> DataFrame:
    """M1: distinct orders and revenue per product row (INNER join)."""
    attrs = ["product_name", "category", "sub_category"]
    per_key = _orders_per_product(star)
    dim = weighted_dim(star.dim_products, "product_key", ["product_id", *attrs], star_dim=True)
    joined = per_key.join(dim, "product_key", "inner")
    return joined.groupBy("product_key", *attrs).agg(
        F.max("_o").alias("total_orders"),
        F.sum(F.col("_s") * F.col("_w")).alias("total_sales_revenue"),
    )


def _order_mart(star: Star, large: list[tuple[DataFrame, str, list[str]]],
                order_attrs: list[str],
                small: list[tuple[DataFrame, str, list[str]]] = ()) -> tuple[DataFrame, object]:
    """Fact joined to the weighted order dimension and then to the others.

    The order dimension comes first: on an order-keyed star both lie in buckets
    of order_key, so the join moves nothing.  ``small`` dimensions, whose rows fan out (ship modes per
    ship date, region names per postal code), are broadcast if their size is within a bound,
    and keep the rows where they are, too.  Each ``large`` one
    (products, customers) that cannot be broadcast then
    costs one shuffle of rows that have not fanned out yet.  Customers come
    last of them, and the reports group by customer key, too, so their grouping
    finds the rows where that join left them.

    Returns the joined rows and the combined weight (product of the dim row
    counts behind each joined row).
    """
    def attach(df, i, dim, key, attrs, hint):
        wname, table = f"_w{i}", _DIM_OF_KEY[key]
        wd = weighted_dim(dim, key, attrs, star_dim=dim is getattr(star, table)).withColumnRenamed("_w", wname)
        return df.join(lattice.bounded(star, wd, table) if hint else wd, key, "left"), _w(wname)

    orders = weighted_dim(star.dim_orders, "order_key", order_attrs, star_dim=True) \
        .withColumnRenamed("_w", "_wo")
    fact = star.fact_sales.withColumn("_m", money("sales"))  # exact money once a line, not once a copy
    joined, weight = fact.join(orders, "order_key", "left"), _w("_wo")
    for i, (spec, hint) in enumerate([(d, False) for d in large] + [(d, True) for d in small]):
        joined, w = attach(joined, i, *spec, hint)
        weight = weight * w
    return joined, weight


def mart_fulfillment(star: Star) -> DataFrame:
    """M2: sales and line count per order, customer, product name and region.

    The region dimension fans out (several cities share a postal code); the
    weighted join multiplies instead of copying rows.
    """
    regions = star.dim_regions.withColumnRenamed("region", "region_name")
    joined, w = _order_mart(
        star,
        large=[
            (star.dim_products, "product_key", ["product_name"]),
            (star.dim_customers, "customer_key", ["customer_id", "customer_name"]),
        ],
        order_attrs=["order_id", "order_date"],
        small=[(regions, "region_key", ["region_name"])],
    )
    return joined.groupBy(
        "customer_key", "order_key", "order_id", "customer_id", "customer_name", "product_name", "region_name"
    ).agg(
        F.sum(F.col("_m") * w).alias("total_sales"),
        F.coalesce(F.sum(F.when(F.col("order_key").isNotNull(), w)), F.lit(0).cast("bigint"))
        .alias("total_orders"),
    ).drop("customer_key")


def mart_shipping(star: Star) -> DataFrame:
    """M3: sales, line count and rounded average shipping days per order,
    customer, region and ship mode.

    Two fan-outs (cities per postal code, modes per ship date) become
    weights; the mode fan-out is the grouping itself and is produced inside
    the broadcast-join stage, right before partial aggregation.  The
    average is sum(days * w) / sum(w) over rows where both dates exist and
    rounds half away from zero like the warehouse cast.
    """
    regions = star.dim_regions.withColumnRenamed("region", "region_name")
    joined, w = _order_mart(
        star,
        large=[(star.dim_customers, "customer_key", ["customer_id", "customer_name"])],
        order_attrs=["order_id", "order_date"],
        small=[
            (regions, "region_key", ["region_name"]),
            (star.dim_shipping, "ship_key", ["ship_mode", "ship_date"]),
        ],
    )
    days = F.datediff("ship_date", "order_date").cast("bigint")
    agg = joined.groupBy(
        "customer_key", "order_key", "order_id", "customer_id", "customer_name", "region_name", "ship_mode"
    ).agg(
        F.sum(F.col("_m") * w).alias("total_sales"),
        F.coalesce(F.sum(F.when(F.col("order_key").isNotNull(), w)), F.lit(0).cast("bigint"))
        .alias("total_orders"),
        F.sum(days * w).alias("_days"),
        F.sum(F.when(days.isNotNull(), w)).alias("_nd"),
    )
    return agg.select(
        "order_key", "order_id", "customer_id", "customer_name", "region_name", "ship_mode",
        "total_sales", "total_orders",
        round_half_away(F.try_divide(F.col("_days").cast("double"), F.col("_nd").cast("double")))
        .alias("avg_shipping_days"),
    )


# ---------------------------------------------------------------- X1-X3

def sales_by_segment(star: Star) -> DataFrame:
    """Sales and distinct orders per customer segment."""
    out = _by_party_attribute(star, star.dim_customers, "customer_key", ["segment"])
    return out.select("segment", F.col("_s").alias("total_sales"), F.col("_o").alias("total_orders"))


def headline_kpis(star: Star) -> DataFrame:
    """Total sales, distinct orders and sales per order, one row."""
    agg = _per_order(star).agg(F.sum("_s").alias("total_sales"), F.count(_one()).alias("total_orders"))
    return agg.select(
        "total_sales", "total_orders",
        money_avg("total_sales", "total_orders").alias("avg_order_value"),
    )


def top_products(star: Star, k: int = 10) -> DataFrame:
    """The k products with the highest sales (ties: smaller key first)."""
    return sales_by_product(star).orderBy(
        F.col("total_sales").desc(), "product_key", "product_name", "category", "sub_category"
    ).limit(k)

