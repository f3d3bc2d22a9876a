"""Connected components by alternating large-star and small-star rounds.

Every round is two pre-aggregated minima and two equi-joins; a node with very
many neighbours is aggregated before the shuffle, and its rows in a join can be
split by adaptive execution. The edge list shrinks towards stars, and each
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    if not large:
        both = both.filter("v <= u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter("a <> b").distinct()


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): of every node with an edge, the smallest node that it reaches.

    edges: (a, b) longs without nulls; loops and repeated edges are ignored.
    """
    now = scratch.keep(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not mark[0] or mark == seen:
            break
        seen = mark
        after = scratch.keep(_star(_star(now, True), False), "edges")
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(now.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
