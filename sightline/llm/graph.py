"""Connected components of an edge table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.store import drop, saved


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One round: larger (or smaller) neighbours of a node hang on the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        below = both.filter("v < u")
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        out = below.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and nothing hangs on it then."""
    up, down = F.sum("up"), F.sum("down")
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    crossed = ends.groupBy("node").agg(((up > 1) | ((up > 0) & (down > 0))).alias("crossed"))
    return not crossed.agg(F.max("crossed")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node with an edge; edges have columns a and b.

    Large-star and small-star rounds alternate until the edges are stars around least
    nodes. Each round is aggregated before its shuffle, and no node's neighbours are
    ever gathered.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _are_stars(now):
        after = saved(_starred(_starred(now, True), False), "edges")
        drop(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
