"""Connected components of an edge list by alternating star contraction, distributed and without a driver-side graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Cut = Callable[[DataFrame, str], DataFrame]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each neighbour above a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    above = both.where("b > a")
    return above.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its neighbours below it to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    linked = down.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(linked.select("a", F.col("least").alias("b"))).where("a <> b")


def connected_components(edges: DataFrame, cut: Cut, rounds: int = 60) -> DataFrame:
    """node and component (its least node) of each node that has an edge to another; edges has a and b of one ordered type.

    cut(df, name) stores a frame where lost executors can't take it and gives it back. Each round shortens paths by about
    half, so the number of rounds grows with the logarithm of the longest path; ends with a RuntimeError after `rounds`.
    """
    edges = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        edges = cut(_small_star(_large_star(edges).where("a <> b").distinct()).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        last = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
