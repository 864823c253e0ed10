"""Connected components by alternating large-star and small-star, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself. A node that a
    large part of the ``n`` edges meet is dealt with in several places."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return spread_join(both.where("v > u"), least, "u", "v", n).select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them. ``u < v`` in edges."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    across = spread_join(edges, least, "v", "u", n).where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b"))
    return across.union(least.select(F.col("m").alias("a"), F.col("v").alias("b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node reachable) for every node with an edge.

    ``edges`` has ``u`` and ``v``; loops and nulls are ignored, repeated edges count once. The
    alternation ends when the edges no longer change: then each node has one edge, to its root.
    """
    now = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now = cut(now)
    mark, n = None, now.count()
    for _ in range(rounds):
        # large stars have as many edges at most, small stars as many and the nodes
        now = cut(_small_star(cut(_large_star(now, n).distinct()), n).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark, n = seen, seen[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
