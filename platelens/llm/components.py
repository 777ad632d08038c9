"""Connected components of an edge table by alternating star contraction.

Large-star then small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond"): every round is two aggregates and two joins, the edges
of each round are written to the shared folder, and the driver sees only a row
count and a checksum. A hub's minimum is a partial aggregate; the join back on it
reads the hub's edges in one task (two numbers each), as the aggregate under the
join keeps AQE from splitting it. Writing the minima first lets AQE split it, but
took twice the time a round with many shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root), root the smallest node reachable.

    Only nodes that have an edge to another node appear; null ends, loops and
    repeated edges are ignored; no edges give no rows.
    """
    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                .where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        e = written(_small_star(_large_star(e)), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
