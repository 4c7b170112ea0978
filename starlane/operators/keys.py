"""Distributed surrogate keys.

A dimension key is the 0-based position of the natural key among its sorted
distinct values (a dense rank), and -1 for null.  A global ``dense_rank()``
window would pull every key into one task, so the rank is built in pieces:

1. distinct non-null values, range-partitioned and sorted within partitions;
2. ``monotonically_increasing_id`` then encodes (partition, position);
3. the frame is written once to the reliable checkpoint folder, because
   range bounds come from a sample and a recomputation must not move values
   between partitions;
4. per-partition counts (one row per partition, a bounded table) become
   prefix offsets that are broadcast back; the finished map is written once
   more so its many lookups are plain scans.

Several key domains (one per dimension) share one pass: the natural keys of
the already distinct dimensions are stacked as (domain, value) with one typed
value column per data type, so each domain keeps its own type's ordering, and
offsets are summed per domain.  Rows of the fact's grain are not read.

Nothing grows with the data except the distributed steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlane.session import read_table_of, remove_path, shuffle_partitions, write_and_read, write_table

#: Keys of a map that is broadcast by hint: the maps lie in one table, whose size is no guide to theirs.
BOUNDED_KEYS = 200_000
_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1


def _slot(type_name: str) -> str:
    return "_v_" + "".join(ch if ch.isalnum() else "_" for ch in type_name)


def dense_codes_many(
    domains: dict[str, tuple[DataFrame, str]],
    num_partitions: int | None = None,
) -> dict[str, DataFrame]:
    """Dense 0-based codes for several key domains in one pass.

    ``domains`` maps key name -> (frame, natural column).  Returns key name ->
    ``(natural column, key)`` with one row per distinct non-null value.
    Null is not in a map; callers turn a failed lookup into -1.
    """
    frames = list(domains.values())
    spark = frames[0][0].sparkSession
    n = num_partitions or shuffle_partitions(spark)
    types = [df.schema[c].dataType.simpleString() for df, c in frames]
    slots = sorted(set(types))

    # Only the slot of a domain's type is filled.
    parts = [
        df.where(F.col(c).isNotNull()).select(
            F.lit(i).alias("_dom"),
            *[(F.col(c) if types[i] == t else F.lit(None).cast(t)).alias(_slot(t)) for t in slots],
        )
        for i, (df, c) in enumerate(frames)
    ]
    stacked = reduce(DataFrame.unionByName, parts).distinct()
    order = [F.col("_dom").asc()] + [F.col(_slot(t)).asc() for t in slots]
    ranged = (
        stacked.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    codes = write_table(ranged, "key_codes")
    ranged = read_table_of(spark, codes, ranged.schema)
    located = ranged.select(
        "_dom",
        *[_slot(t) for t in slots],
        F.shiftright(F.col("_mid"), _POS_BITS).alias("_part"),
        F.col("_mid").bitwiseAND(F.lit(_POS_MASK)).alias("_pos"),
    )
    # One row per (partition, domain): bounded by n * len(domains), safe to
    # rank in one task per domain and to broadcast.
    sizes = located.groupBy("_part", "_dom").agg(
        F.count(F.lit(1)).alias("_size"), F.min("_pos").alias("_first")
    )
    before = Window.partitionBy("_dom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", "_dom", "_first",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    coded = located.join(F.broadcast(offsets), ["_part", "_dom"]).select(
        "_dom", *[_slot(t) for t in slots],
        (F.col("_offset") + F.col("_pos") - F.col("_first")).cast("bigint").alias("_key"),
    )
    # Every dimension and the fact look keys up here: write the finished
    # map once so each lookup is a plain (domain-filtered) scan.
    coded = write_and_read(coded, "key_map")
    remove_path(spark, codes)
    counts = {r["_dom"]: r["_n"] for r in coded.groupBy("_dom").agg(F.count(F.lit(1)).alias("_n")).collect()}
    maps = {
        key: coded.where(F.col("_dom") == i).select(
            F.col(_slot(types[i])).alias(c), F.col("_key").alias(key)
        )
        for i, (key, (_, c)) in enumerate(domains.items())
    }
    return {key: F.broadcast(m) if counts.get(i, 0) <= BOUNDED_KEYS else m for i, (key, m) in enumerate(maps.items())}


def dense_codes(
    values: DataFrame,
    col: str,
    key: str,
    num_partitions: int | None = None,
) -> DataFrame:
    """Map each distinct non-null ``col`` value to its 0-based sorted rank."""
    return dense_codes_many({key: (values, col)}, num_partitions)[key]


def attach_key(df: DataFrame, codes: DataFrame, col: str, key: str) -> DataFrame:
    """Left-join a code map on ``col``; a null or unmatched value gets -1."""
    return df.join(codes, on=col, how="left").withColumn(
        key, F.coalesce(F.col(key), F.lit(-1).cast("bigint"))
    )
