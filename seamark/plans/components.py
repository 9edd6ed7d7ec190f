"""Connected components of a large graph by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node.

    ``edges`` has columns a and b in either order; ``cut`` writes a frame where
    executors share it and reads it back.  Every round is two aggregations by
    node that combine map-side, and two joins.  What the joins read is cut off
    first: a join on top of an aggregation by the same key keeps its partitions
    and couldn't split a hub's rows.  The number of rounds grows with the
    logarithm of the longest chain.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        # Large star: what is larger than a node goes to the node's least neighbour.
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node's smaller neighbours, and itself, go to the least of them.
        large = cut(large.distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        stars = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
