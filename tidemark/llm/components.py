"""Connected components of a graph too large for one machine, by alternating star contractions.

Each round replaces the edges of a node by edges to its smallest neighbour: first for the larger neighbours
("large star"), then for the smaller ones ("small star").  The components stay what they were, and after about
log(n) rounds every node hangs on its component's minimum.  A hub's edges are never gathered: its minimum comes
from a partial aggregation and reaches the edges through a join whose large side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges (u long, v long)``; component is the smallest node in reach.

    Self loops and repeated edges do no harm; nodes without a proper edge are absent from the result.
    """
    now = stage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    signature = None
    for _ in range(max_rounds):
        now = stage(_small_star(_large_star(now)), "edges")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(row) == signature:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        signature = tuple(row)
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
