"""Connected areas of many photos at once, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.tables import dropped, settled


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (photo_id, node) with ``label``: the least node that edges (photo_id, a, b) lead to.

    In each round a node takes the least label around it, and then that label's own label, so
    that far ends of an area meet in few rounds. Rounds end when no label changes. All shuffles
    are by photo and node; no area is gathered.
    """
    both = settled(edges.select("photo_id", "a", "b").unionByName(edges.select("photo_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    now = settled(nodes.select("photo_id", "node", F.col("node").alias("label")))
    while True:
        around = both.join(now.select("photo_id", F.col("node").alias("b"), "label"), ["photo_id", "b"]).groupBy("photo_id", F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(around, ["photo_id", "node"], "left").select("photo_id", "node", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        further = now.select("photo_id", F.col("node").alias("near"), F.col("label").alias("far"))
        after = settled(step.join(further, ["photo_id", "near"]).select("photo_id", "node", "old", F.least("near", "far").alias("label")))
        dropped(now)
        now = after
        if after.filter("label <> old").isEmpty():
            dropped(both)
            return now.select("photo_id", "node", "label")
