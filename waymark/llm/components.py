"""Connected components of a graph of links, by alternating star contractions.

Each round joins the links with the least neighbour of every node (large star: greater
neighbours move to the least; small star: smaller neighbours do), so the number of rounds
grows with the logarithm of a component's size.  Nothing is collected per node: least
neighbours are minima with partial sums, and the joins are equi-joins whose hot keys Spark
splits.  Only a count of changed links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import drop, materialize


def _star(links: DataFrame) -> DataFrame:
    """One large star and one small star over links (a > b)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(down, "u")
    small = moved.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return small.where("a != b").distinct()


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """``links``: columns a and b, any order, with or without repeats.  Returns node, component for every node that has a link; component is the least node reachable.

    Null ends and links of a node to itself are ignored.
    """
    now = materialize(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        after = materialize(_star(now), "links")
        drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # At the fixed point every node has one link, to its component's least node.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
