"""Flat order-line input (S1) and its stand-in built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlane.session import input_bytes, size_shuffles

# Flat order-line schema, snake_case.  Dates arrive as day-first text; the
# postal code is numeric and nullable, as CSV inference would make it.
FLAT_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("order_id", T.StringType(), True),
        T.StructField("order_date_s", T.StringType(), True),
        T.StructField("ship_date_s", T.StringType(), True),
        T.StructField("ship_mode", T.StringType(), True),
        T.StructField("customer_id", T.StringType(), True),
        T.StructField("customer_name", T.StringType(), True),
        T.StructField("segment", T.StringType(), True),
        T.StructField("country", T.StringType(), True),
        T.StructField("city", T.StringType(), True),
        T.StructField("state", T.StringType(), True),
        T.StructField("region", T.StringType(), True),
        T.StructField("postal_code", T.DoubleType(), True),
        T.StructField("product_id", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("sub_category", T.StringType(), True),
        T.StructField("product_name", T.StringType(), True),
        T.StructField("sales", T.DoubleType(), True),
    ]
)

FLAT_COLUMNS = [f.name for f in FLAT_SCHEMA.fields]

# Header names of the original export, in schema order.
CSV_HEADER = [
    "Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode",
    "Customer ID", "Customer Name", "Segment", "Country", "City", "State",
    "Region", "Postal Code", "Product ID", "Category", "Sub-Category",
    "Product Name", "Sales",
]


# Fields as text under the export's header names; types are applied after null tokens.
CSV_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in CSV_HEADER])

# Texts that common CSV readers take for a missing value.
NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _field(header: str, field: T.StructField, tokens: tuple[str, ...]):
    text = F.when(~F.col(f"`{header}`").isin(*tokens), F.col(f"`{header}`")) if tokens else F.col(f"`{header}`")
    if isinstance(field.dataType, T.StringType):
        return text.alias(field.name)
    typed = F.trim(text).try_cast(field.dataType)
    wrong = F.raise_error(F.concat(F.lit(f"{header} is not a number: "), text)).cast(field.dataType)
    return F.when(text.isNotNull() & typed.isNull(), wrong).otherwise(typed).alias(field.name)


def read_flat_csv(
    spark: SparkSession, path: str, multi_line: bool = False, null_tokens: tuple[str, ...] = NULL_TOKENS
) -> DataFrame:
    """Read flat CSV order lines with a header and an explicit schema.

    No inference pass: the schema is fixed, so a 100 TB input is read once
    and every file gets the same types.  Quotes inside quoted fields are
    doubled, as CSV writers do.  ``multi_line`` allows line ends inside quoted
    fields; such files cannot be split, so it is off by default.  Fields that
    are empty or one of ``null_tokens`` are null.  Every file's header is
    checked against the expected names (``enforceSchema`` off), a malformed line
    or number fails the read, and columns come out in snake_case.
    """
    raw = (
        spark.read.schema(CSV_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    return raw.select([_field(h, f, null_tokens) for h, f in zip(CSV_HEADER, FLAT_SCHEMA.fields)])


def write_flat_csv(df: DataFrame, path: str) -> None:
    """Write flat rows as CSV with the original header names, quotes doubled."""
    renamed = df.select([F.col(c).alias(h) for c, h in zip(FLAT_COLUMNS, CSV_HEADER)])
    renamed.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STANDIN_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")


def standin_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat order lines derived from the TPC-H-like test tables.

    lineitem x orders x customer x nation x region x part, all inner.  Every
    line of an order whose key is a multiple of 100 appears twice (planted
    exact duplicates for the dedupe step); the copy is made with a generator
    in the same pass, so the join runs once.  Mapping rules are listed in
    FIXTURES.md section 2.

    Orders meet their customers and lines their parts first, so where no side
    is small enough to broadcast, the finished wide lines are shuffled once.
    """
    size_shuffles(spark, input_bytes(spark, [f"{sf_dir}/{t}.parquet" for t in STANDIN_TABLES]))
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    )
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")

    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    cust = customer.join(geo, customer.c_nationkey == geo.n_nationkey)
    lines = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(orders.join(cust, orders.o_custkey == cust.c_custkey), li.l_orderkey == orders.o_orderkey)
    )
    # Planted duplicates: lines of every 100th order appear twice.  This adds
    # rows on top of the whole table; it never selects a subset.
    copies = F.when(F.col("o_orderkey") % 100 == 0, F.lit(2)).otherwise(F.lit(1))
    custkey_s = F.col("c_custkey").cast("string")
    flat = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("row_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date_s"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("ship_date_s"),
        F.col("o_orderpriority").alias("ship_mode"),
        custkey_s.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("WORLD").alias("country"),
        F.concat(F.col("n_name"), F.lit("_"), (F.col("c_custkey") % 20).cast("string")).alias("city"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("region"),
        F.when(F.col("c_custkey") % 97 == 0, F.lit(None).cast("double"))
        .otherwise((F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).cast("double"))
        .alias("postal_code"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_type").alias("category"),
        F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand")).alias("sub_category"),
        F.col("p_name").alias("product_name"),
        F.col("l_extendedprice").cast("double").alias("sales"),
        copies.alias("_copies"),
    )
    return flat.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop(
        "_copies", "_copy"
    )
