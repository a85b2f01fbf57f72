"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.session import durable


def _to_smallest(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """One star step: every neighbour (or every larger one) of a node is linked to the smallest node around it."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = pairs.join(least, "u")
    if larger_only:
        linked = linked.where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _state(pairs: DataFrame):
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that occurs in ``links(u, v)``; the root is the smallest node reachable.

    Each round halves the distances at least, takes two joins on node ids and is written to the shared folder. The
    smallest neighbour is found by a partial aggregate, so a node with many links is no hot group.
    """
    pairs = durable(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _state(pairs)
    while before["n"]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, larger_only=True)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        pairs = durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = _state(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
