"""Connected components by alternating star contraction (DataFrame joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.session import materialize


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, comp)`` for every linked node but the
    smallest of its component; ``comp`` is that smallest node.

    Each round points every larger neighbour, then every smaller one, at the
    smallest known node; a logarithmic number of rounds is usual.  Rounds are
    cut with reliable checkpoints, and only a count and a checksum of the
    edges come to the driver.
    """
    edges = materialize(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = state
        both = edges.unionByName(_flip(edges))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
