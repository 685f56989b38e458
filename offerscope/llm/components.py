"""Connected components by alternating large-star and small-star steps.

Every step is one job of joins and aggregates over the links; its result is
written to the shared folder, so a lost executor costs a re-read.  A vertex
with many links is never gathered: minima are pre-aggregated before the
shuffle and the join with them can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a, b; longs): root is
    the least node of its component.  Loops, repeated links and both
    directions may occur; no links give no rows."""
    def written(frame: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = scratch.write(frame.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), f"{name}-{k}")
        return out, (seen.get["n"], seen.get["h"])

    k = 0
    edges, mark = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), k)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        small = large.join(low.withColumnRenamed("v", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        k += 1
        edges, now = written(low.unionByName(small).distinct(), k)
        scratch.drop(f"{name}-{k - 1}")
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
