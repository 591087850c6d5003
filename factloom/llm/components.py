"""Connected components of an edge table by alternating stars; every step is a join on one node and a minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return n, total or 0


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) of every node of the undirected edges ``a, b`` (longs; loops and nulls are dropped).

    Large star: each neighbour above a node is linked to the node's smallest neighbour; small star: each neighbour
    below likewise. Edges stay linear in number, minima are combined before the shuffle, and a hub's edges may be
    split over tasks, since only its minimum (one row, read from a written table) meets them. Rounds go on until one
    changes nothing; their number grows with the logarithm of the nodes.
    """
    rows = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rows = materialize(rows, "cc")
    state = _state(rows)
    while state[0]:
        both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-min")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "cc-large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-min")
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        small = small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        rows = materialize(small, "cc")
        now = _state(rows)
        if now == state:
            break
        state = now
    stars = rows.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(rows.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
