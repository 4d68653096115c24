"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b bigint), in any direction, repeats allowed. Returns (node, root): root is the smallest node reachable.

    Only nodes of an edge to another node occur. A hub's edges are spread by partial aggregation and by a join whose large
    partitions Spark can split. Every round is written to the shared folder. Nulls never match: such edges are dropped.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        # Large star: larger neighbours of each node go to its smallest neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours, and the node, go to the smallest of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        if (now := _state(e)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
