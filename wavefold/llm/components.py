"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.llm.shared import discard, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with v < u: neighbours are tied to the least one."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, component (the least node reachable) of every node that has a link.

    ``links`` has a and b. Each round is written to ``folder``, so a lost executor
    costs one round at most and the round before is deleted; nothing but a count
    and a checksum comes to the driver. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen, n = written(edges, folder, "0"), None, 0
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).collect()[0]
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen, n = now, n + 1
        edges = written(_stars(_stars(edges, True), False), folder, f"{n}")
        discard(links.sparkSession, folder, f"{n - 1}")
