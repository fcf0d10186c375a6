"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (longs ``a`` and ``b``).

    Each round's edges and minima are written tables, so a hub's join is one that Spark can split, and the
    driver sees a count and a checksum only. Rounds grow with the logarithm of the nodes.
    """
    now, was, seen = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_at = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large, large_at = scratch.write(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2, low2_at = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, at = scratch.write(moved.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (low_at, large_at, low2_at, was):
            if old:
                scratch.drop(old)
        was = at
        if state == seen:
            break
        seen = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
