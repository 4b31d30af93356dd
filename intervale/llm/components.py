"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (large) or smaller-or-equal (small) neighbours to its least neighbour."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = near.join(least, "a")
    if large:
        linked = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """node -> component (the least node it reaches), for all nodes of `edges` (a, b: bigint; loops count for nothing).

    Each round is written to the shared folder; only its size and a checksum come to the driver. An empty table
    gives an empty one; repeated edges and nulls are dropped.
    """
    now = scratch.table(edges.where("a <> b").select("a", "b").distinct(), f"{name}-0")
    seen = None
    for k in range(1, most_rounds + 1):
        after = scratch.table(_star(_star(now, True), False), f"{name}-{k}")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        now = after
        if sums == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = sums
    raise RuntimeError("components did not settle")
