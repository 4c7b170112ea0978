"""Sharding by a hierarchical weighted hash tree.

The cluster is a tree of regions, racks and shards, each shard with a weight;
a rack or region weighs what lies below it.  A key descends the tree: at each
level every child draws ``-ln(u) / weight`` from a hash of key and child, and
the smallest draw wins.  So each level splits in proportion to weight, and the
place of a key depends on nothing but the key and the tree.  When weights
change, keys move only inside (or into) the subtrees whose weights changed.

A shard added in a region of its own takes keys only into itself: no old
weight changes, so a key either draws the new region or stays where it is.
That is how ``with_new_shard`` grows the tree, and the law that holds is
``key``: the id and the tree decide.

``slots`` numbers the rows of each shard from 0 without gaps in two passes of
short rows: rows are counted by shard and hash bucket, and a row's number
follows from the counts before its bucket and its place in the bucket.  Equal
rows are counted, not listed, so neither a hot id nor copies meet in a task.

Everything is DataFrame expressions.  A null id is a key of its own (all such
rows share a shard); a null text has no bytes.  Equal ids share a shard.  Extra
columns stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096  # hash buckets of each shard in which rows are counted
STRIDE = 10_000  # copies of a row that are expanded at once


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> list[Shard]:
    """``shards`` of equal weight, dealt over regions and racks."""
    return [Shard(f"region{i % regions}", f"rack{i // regions % racks}", i) for i in range(shards)]


def with_new_shard(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own."""
    number = max((s.shard for s in tree), default=-1) + 1
    return [*tree, Shard(f"region-of-{number}", f"rack-of-{number}", number, weight)]


def reweighted(tree: list[Shard], shard: int, weight: float) -> list[Shard]:
    return [replace(s, weight=weight) if s.shard == shard else s for s in tree]


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw with rate ``weight``, fixed by key and child."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def _descend(key: Column, tree: list[Shard], path: str = "") -> Column:
    """The shard that ``key`` reaches below ``path``."""
    level = path.count("/")
    if level == 3:
        return F.lit(tree[0].shard)
    children: dict[str, list[Shard]] = {}
    for s in tree:
        if s.weight > 0:
            children.setdefault((s.region, s.rack, str(s.shard))[level], []).append(s)
    names = sorted(children)
    below = [_descend(key, children[n], f"{path}{n}/") for n in names]
    if len(names) == 1:
        return below[0]
    draws = [F.struct(_draw(key, f"{path}{n}", sum(s.weight for s in children[n])).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(names)]
    winner = F.least(*draws)["i"]
    return F.get(F.transform(F.array(winner), lambda w: _pick(w, below)), F.lit(0))


def _pick(winner: Column, values: list[Column]) -> Column:
    out = values[-1]
    for i in range(len(values) - 2, -1, -1):
        out = F.when(winner == i, values[i]).otherwise(out)
    return out


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of each key, as an expression."""
    if not any(s.weight > 0 for s in tree):
        raise ValueError("a tree needs a shard of positive weight")
    return _descend(key, tree).cast("int")


def assign(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """The columns of ``docs`` as ``row``, and ``shard``."""
    return docs.select(F.struct("*").alias("row")).withColumn("shard", shard_of(F.col("row.doc_id"), tree))


def slots(rows: DataFrame) -> DataFrame:
    """Add ``slot`` (in the place of a column of that name): the number of each
    row in its ``shard``, from 0.  The columns travel as one struct, so their
    names cannot clash with those used here; a row that occurs often is counted
    once and expanded ``STRIDE`` copies at a time."""
    columns = [c for c in rows.columns if c != "slot"]
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns]
    packed = rows.select("shard", F.struct(*quoted).alias("row"))
    bucket = F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int")
    kinds = packed.withColumn("bucket", bucket).groupBy("shard", "row", "bucket").agg(F.count("*").alias("times"))
    sizes = kinds.groupBy("shard", "bucket").agg(F.sum("times").alias("size"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("shard", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "bucket").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    kinds = kinds.withColumn("ahead", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    first = F.col("start") + F.col("ahead")
    placed = kinds.join(sizes, ["shard", "bucket"]).select("row", first.alias("first"), (first + F.col("times") - 1).alias("last"))
    strides = placed.select("row", "last", F.explode(F.sequence("first", "last", F.lit(STRIDE).cast("long"))).alias("at"))
    copies = F.sequence("at", F.least(F.col("at") + STRIDE - 1, F.col("last")))
    done = strides.select("row", F.explode(copies).alias("slot"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in columns], "slot")
