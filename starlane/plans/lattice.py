"""Aggregates of the fact that several reports are rolled up from.

Two tables, both at the grain of an order and bucketed on ``order_key`` like
the fact of an order-keyed star, so that building them moves no fact row:

* ``order_products`` -- one row an order and product key.  A product's distinct
  orders are its rows here (A2, M1), and its sums are sums of these (K2-K4).
* ``order_parties`` -- one row an order, customer key and region key (A1, A5, K5, X1, X2).

``store`` writes those that a report needs, each once per star; a report takes the
stored table if there is one and the same aggregation of the fact otherwise.
The sums per product key, which five reports share, are kept once made, too.

Distinct orders per attribute of a dimension are counted in two ways:

* by orders with a single key.  Nearly every order has one customer and one
  region.  Such an order counts once for each attribute of its key,
  so orders are counted per key first (a map-side count, no pairs
  are shuffled), and only the orders with several keys, if there are
  any, are made distinct per attribute;
* by bitmaps, for attributes of products, of which an order has several.  Order
  keys are dense, so the orders of an attribute are the bits of a few blocks of
  32,768.  A block takes 4 KB, a pair of attribute and order
  about 16 bytes: ``bitmaps_pay`` compares the two, and pairs are made distinct
  where bitmaps would be mostly empty.  Both are exact.
"""

from __future__ import annotations

import uuid
import weakref
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.functions.money import money_sum
from starlane.operators.star import Star
from starlane.session import read_table_of, remove_path, scratch_path, shuffle_partitions, write_table
from starlane.sources.tables import write_keyed

BITS = 8 * 4096  # orders in a block of a bitmap
PAIR_BYTES = 16
#: Rows of a dimension that is broadcast by hint; larger ones are left to the planner.
BOUNDED_ROWS = 200_000


TABLES = ("order_products", "order_parties")


@dataclass
class _Stored:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)  # catalog table -> path
    shared: dict[str, bool] = field(default_factory=dict)  # whether orders have several keys of a kind
    per_product: tuple[str, DataFrame] | None = None  # path, table


_STORED: "weakref.WeakKeyDictionary[Star, _Stored]" = weakref.WeakKeyDictionary()
_COUNTS: "weakref.WeakKeyDictionary[Star, dict[str, int]]" = weakref.WeakKeyDictionary()


def _products_of(fact: DataFrame) -> DataFrame:
    lines, priced = F.count(F.lit(1)).alias("_n"), F.count("sales").alias("_ns")
    return fact.groupBy("order_key", "product_key").agg(money_sum("sales").alias("_s"), lines, priced)


def _parties_of(fact: DataFrame) -> DataFrame:
    return fact.groupBy("order_key", "customer_key", "region_key").agg(money_sum("sales").alias("_s"))


def order_products(star: Star) -> DataFrame:
    """``order_key, product_key, _s`` (sales), ``_n`` (lines) and ``_ns`` (lines with sales)."""
    return _STORED[star].tables["order_products"] if stored(star, "order_products") else _products_of(star.fact_sales)


def order_parties(star: Star) -> DataFrame:
    """``order_key, customer_key, region_key, _s``."""
    return _STORED[star].tables["order_parties"] if stored(star, "order_parties") else _parties_of(star.fact_sales)


def per_product(star: Star) -> DataFrame:
    """``product_key, _o`` (distinct orders), ``_s``, ``_n`` and ``_ns``."""
    sums = [F.sum(c).alias(c) for c in ("_s", "_n", "_ns")]
    out = order_products(star).groupBy("product_key").agg(F.count(F.lit(1)).alias("_o"), *sums)
    if not stored(star, "order_products"):
        return out
    held = _STORED[star]
    if held.per_product is None:
        path = write_table(out, "per-product")
        held.per_product = path, read_table_of(out.sparkSession, path, out.schema)
    return held.per_product[1]


def stored(star: Star, *names: str) -> bool:
    """Whether the tables (all by default) are stored."""
    return star in _STORED and set(names or TABLES) <= set(_STORED[star].tables)


def store(star: Star, *names: str) -> None:
    """Write the tables (all by default), unless they are."""
    spark, held = star.fact_sales.sparkSession, _STORED.setdefault(star, _Stored())
    for name in names or TABLES:
        if name not in held.tables:
            df = {"order_products": _products_of, "order_parties": _parties_of}[name](star.fact_sales)
            run = uuid.uuid4().hex[:12]
            table, path = f"starlane_{name}_{run}", scratch_path(spark, f"{name}-{run}")
            held.names[table] = path
            held.tables[name] = write_keyed(df, table, path, "order_key", placed=star.keyed)


def release(star: Star) -> None:
    """Delete the stored tables of ``star``."""
    held = _STORED.pop(star, None)
    if held:
        spark = star.fact_sales.sparkSession
        if held.per_product:
            remove_path(spark, held.per_product[0])
        for table, path in held.names.items():
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove_path(spark, path)


def _count(star: Star, table: str) -> int:
    counts = _COUNTS.setdefault(star, {})
    if table not in counts:
        counts[table] = getattr(star, table).count()
    return counts[table]


def bounded(star: Star, dim: DataFrame, table: str) -> DataFrame:
    """``dim``, derived from a dimension table, hinted for a broadcast if that
    table has at most ``BOUNDED_ROWS``."""
    return F.broadcast(dim) if _count(star, table) <= BOUNDED_ROWS else dim


def _per_order(parties: DataFrame, key: str) -> DataFrame:
    """Per order: how many keys it has (``_k``), the key if that is one, and its sales."""
    pairs = parties.groupBy("order_key", key).agg(F.sum("_s").alias("_s"))
    return pairs.groupBy("order_key").agg(F.count(F.lit(1)).alias("_k"), F.max(key).alias(key), F.sum("_s").alias("_s"))


def orders_may_share(star: Star, key: str) -> bool:
    """Whether some order may have several keys (certain only once stored)."""
    if not stored(star, "order_parties"):
        return True
    held = _STORED[star]
    if key not in held.shared:
        held.shared[key] = not _per_order(held.tables["order_parties"], key).filter("_k > 1").isEmpty()
    return held.shared[key]


def shared_pairs(star: Star, key: str) -> DataFrame:
    """``order_key, key, _s`` of the orders with several keys."""
    pairs = order_parties(star).groupBy("order_key", key).agg(F.sum("_s").alias("_s"))
    several = _per_order(order_parties(star), key).filter("_k > 1").select("order_key")
    return pairs.join(several, "order_key", "left_semi")


def alone_by_key(star: Star, key: str) -> DataFrame:
    """``key, _s, _o``: sales and number of the orders that have this key alone."""
    alone = _per_order(order_parties(star), key).filter("_k = 1")
    return alone.groupBy(key).agg(F.sum("_s").alias("_s"), F.count(F.lit(1)).alias("_o"))


def bitmaps_pay(star: Star, groups: int) -> bool:
    """Whether the bitmaps of ``groups`` attributes, in each task that builds
    them, take less than the pairs that they stand for."""
    blocks = 1 + _count(star, "dim_orders") // BITS
    tasks = shuffle_partitions(star.fact_sales.sparkSession)
    return groups * blocks * tasks * (BITS // 8) <= _count(star, "fact_sales") * PAIR_BYTES


def distinct_orders(rows: DataFrame, attrs: list[str], bitmaps: bool) -> DataFrame:
    """``attrs, _s, _o``: the sum of ``_s`` and the distinct orders of ``rows``
    (``order_key``, ``attrs``, ``_s``)."""
    if not bitmaps:
        pairs = rows.groupBy(*attrs, "order_key").agg(F.sum("_s").alias("_s"))
        return pairs.groupBy(*attrs).agg(F.sum("_s").alias("_s"), F.count(F.lit(1)).alias("_o"))
    block = F.bitmap_bucket_number("order_key").alias("_block")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("order_key")).alias("_bits")
    blocks = rows.groupBy(*attrs, block).agg(F.sum("_s").alias("_s"), bits)
    return blocks.groupBy(*attrs).agg(F.sum("_s").alias("_s"), F.sum(F.bitmap_count("_bits")).alias("_o"))
