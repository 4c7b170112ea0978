"""Star-schema build."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

from starlane.operators.keys import attach_key, dense_codes_many
from starlane.session import run_concurrently, write_and_read

# Each dimension is distinct on all of its columns, but its key
# encodes only one natural column (so keys can repeat across dim rows).
DIMENSIONS = {
    "dim_orders": (["order_id", "order_date"], "order_id", "order_key"),
    "dim_shipping": (["ship_date", "ship_mode"], "ship_date", "ship_key"),
    "dim_customers": (["customer_id", "customer_name", "segment"], "customer_id", "customer_key"),
    "dim_regions": (["country", "city", "state", "region", "postal_code"], "postal_code", "region_key"),
    "dim_products": (["product_id", "category", "sub_category", "product_name"], "product_id", "product_key"),
}

#: Tables that meet on the order key in most reports.
ORDER_KEYED = ("fact_sales", "dim_orders")

FACT_KEYS = ["order_key", "ship_key", "customer_key", "region_key", "product_key"]


@dataclass(frozen=True)
class Star:
    """The fact and its five dimensions.

    Invariants the report plans rely on: every dimension is distinct on all
    of its columns, and its key is a function of one natural column (so
    keys may repeat across rows, never the other way round).
    """

    fact_sales: DataFrame
    dim_orders: DataFrame
    dim_shipping: DataFrame
    dim_customers: DataFrame
    dim_regions: DataFrame
    dim_products: DataFrame
    keyed: bool = False  # fact and order dimension lie in buckets of order_key

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "keyed"}

    def written(self) -> "Star":
        """Write every table once (Parquet, reliable folder) and read back.

        The six writes are independent jobs, submitted together so Spark's
        scheduler can run their stages side by side instead of leaving
        executors idle behind the small dimension jobs."""
        return replace(self, **run_concurrently(
            {n: (lambda df=df, n=n: write_and_read(df, n)) for n, df in self.tables().items()}))


def distinct_dimensions(clean: DataFrame) -> dict[str, DataFrame]:
    """The distinct rows of each dimension, still without keys."""
    return {name: clean.select(cols).distinct() for name, (cols, _, _) in DIMENSIONS.items()}


def key_maps(dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Natural key -> surrogate key for all five dimensions, one
    distributed dense-rank pass over the keys of the distinct dimensions."""
    return dense_codes_many({key: (dims[name], natural) for name, (_, natural, key) in DIMENSIONS.items()})


def build_dimension(rows: DataFrame, name: str, codes: DataFrame) -> DataFrame:
    """Distinct dim rows with their surrogate key."""
    cols, natural, key = DIMENSIONS[name]
    return attach_key(rows, codes, natural, key).select(*cols, key)


def build_fact(clean: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Swap the five natural keys for surrogate keys, keep sales, dedupe.

    Each surrogate key is an injective function of its natural key (null ->
    -1), so deduplicating on (sales, natural keys) gives exactly the rows of
    deduplicating on (sales, surrogate keys).  The maps are unique per
    natural key, so no lookup fans out.

    Order of work: the order-id lookup comes first.  When that map is too
    large to broadcast it is a sort-merge join, which leaves rows
    hash-partitioned by order_id; the DISTINCT that follows keeps order_id
    among its keys, so that partitioning already satisfies it and the
    dedupe adds no second shuffle of the fact.  The other four (smaller)
    lookups run on the deduplicated rows.
    """
    naturals = [DIMENSIONS[d][1] for d in DIMENSIONS]
    fact = attach_key(clean.select("sales", *naturals), maps["order_key"], "order_id", "order_key")
    fact = fact.select("sales", "order_id", "order_key", *naturals[1:]).distinct()
    for name, (_, natural, key) in DIMENSIONS.items():
        if key != "order_key":
            fact = attach_key(fact, maps[key], natural, key)
    return fact.select("sales", *FACT_KEYS)


def build_star(clean: DataFrame, stage_clean: bool = True, stored: bool = False) -> Star:
    """Clean flat lines -> fact_sales + five dimensions (lazy frames).

    The cleaned lines feed six scans (five dimensions and the fact), so by
    default they are written once (Parquet) first, so each scan reads only
    the columns it needs.  The distinct dimensions are written next: the key
    maps and the finished dimensions come from those.  ``stored`` says that the
    lines are a stored table already, as ``clean_parts`` leaves them.
    """
    if stage_clean and not stored:
        clean = write_and_read(clean, "clean_lines")
    rows = distinct_dimensions(clean)
    if stage_clean:
        rows = run_concurrently({n: (lambda df=df, n=n: write_and_read(df, f"{n}_rows")) for n, df in rows.items()})
    maps = key_maps(rows)
    dims = {name: build_dimension(rows[name], name, maps[spec[2]]) for name, spec in DIMENSIONS.items()}
    return Star(fact_sales=build_fact(clean, maps), **dims)
