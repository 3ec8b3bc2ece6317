"""Connected components by alternating large-star and small-star steps over an edge table.

Nothing of the graph reaches the driver but the number of edges that changed.  Each round's edges
are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v: link neighbours of each node to its smallest one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    ``edges`` holds (a, b) in any order and may repeat; self-loops count for nothing.  Raises if
    ``most_rounds`` (enough for paths of 2**60 nodes) do not settle it.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.keep(now)
    mark = None
    for _ in range(most_rounds):
        old, now = now, scratch.keep(_star(_star(now, True), False))
        scratch.drop(old)
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (r["n"], r["s"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = (r["n"], r["s"])
    raise RuntimeError("components did not settle")
