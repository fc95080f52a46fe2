"""Connected components of an edge table, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Least reachable node for every node of the undirected edges (a, b).

    Alternates two star steps until nothing changes: each node points its larger
    neighbours at its least neighbour, then its smaller ones. Every
    step is one aggregation and one join on node ids; a node with very
    many neighbours is a skewed join key that Spark splits, never one group in memory.
    Each round's table is written, so a lost executor repeats one round at most.

    Returns (node, component) for the nodes that occur in ``edges``; nulls must not
    occur. Empty edges give no rows.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = None
    for _ in range(rounds):
        # large star: all neighbours of u that are above u point at the least of them and u
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("_low")).select(
            "u", F.least("u", "_low").alias("low"))
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(
            F.col("b").alias("a"), F.col("low").alias("b")).where(F.col("a") != F.col("b")).distinct()
        # small star: the smaller neighbours of u, and u, point at the least of them
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))
        small = large.join(low, F.col("a") == F.col("u")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                              F.struct(F.col("u").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        now = written(small.where(F.col("a") != F.col("b")).distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component")))
