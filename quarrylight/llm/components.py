"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spill, spill


def _lower(edges: DataFrame, both: bool) -> DataFrame:
    """Link the neighbours of every node (with ``both``: the larger ones) to the least node around it."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    moved = pairs.join(least, "u")
    if both:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in ``edges`` (u, v: comparable ids, in any order).

    Each round is one job over spilled edges; the number of rounds is logarithmic in the path length,
    and no node's neighbours are gathered. Loops and repeated edges are allowed; no edges, no rows.
    """
    spark = edges.sparkSession
    now = spill(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == (seen["n"], seen["x"]) or seen["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (seen["n"], seen["x"])
        new = spill(spark, _lower(_lower(now, True).distinct(), False).where("u <> v").distinct())
        drop_spill(spark, now)
        now = new
