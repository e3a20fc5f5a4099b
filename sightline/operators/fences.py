"""Fence figures from pixels, in relations: bright vertical lines, their connected areas, and what they cover.

Only bright pixels are kept, and these soon become vertical runs (photo, column, first and last row). An opening
with a rectangle three wide keeps the pixels with bright neighbours to both sides, then the
vertical runs as long as the rectangle, widened by one column again; beyond the border everything
counts as bright, so a run that touches it may be shorter. Areas, their sizes and their
covers follow from the runs alone.

All windows and aggregates are within a photo: the pixels are shuffled once, by photo, or not at all where they lie by photo. Photos
of any size go together, as the rectangle's height is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import scoring as S
from sightline.operators.labels import connected
from sightline.operators.tables import settled

#: Pictures with a shorter side have no figures.
LEAST_SIDE = 50


def opened_runs(pixels: DataFrame, s: dict) -> DataFrame:
    """Vertical runs of what an opening leaves of the bright pixels: photo_id, h, w, c, r0, r1. ``pixels`` has photo_id, h, w, r, c and v."""
    f = s["fence_detection"]
    bright = pixels.filter((F.col("v") > float(f["bright_threshold"])) & (F.least("h", "w") >= LEAST_SIDE)).select("photo_id", "h", "w", "r", "c")
    across = Window.partitionBy("photo_id").orderBy("r", "c")  # by photo alone, so that pixels which lie by photo aren't shuffled, and others once
    beside = lambda f, step: F.coalesce((f("r").over(across) == F.col("r")) & (f("c").over(across) == F.col("c") + step), F.lit(False))
    left, right = (F.col("c") == 0) | beside(F.lag, -1), (F.col("c") == F.col("w") - 1) | beside(F.lead, 1)
    inner = bright.withColumn("inner", left & right).filter("inner")
    runs = inner.withColumn("island", F.col("r") - F.row_number().over(Window.partitionBy("photo_id", "c").orderBy("r")))
    runs = runs.groupBy("photo_id", "h", "w", "c", "island").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).drop("island")
    tall = F.greatest(F.lit(10), F.rint(F.col("h") * float(f["vertical_kernel_height_ratio"])).cast("int"))
    above, n = F.floor(tall / 2), F.col("r1") - F.col("r0") + 1  # rows of the rectangle over its anchor
    top, low = F.col("r0") == 0, F.col("r1") == F.col("h") - 1
    runs = runs.filter((n >= tall) | (top & (n >= tall - above)) | (low & (n >= above + 1)) | (top & low))
    wide = runs.select("photo_id", "h", "w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("c") - 1), F.least(F.col("w") - 1, F.col("c") + 1))).alias("c"), "r0", "r1")
    down = Window.partitionBy("photo_id", "c").orderBy("r0", "r1")
    before = F.max("r1").over(down.rowsBetween(Window.unboundedPreceding, -1))
    merged = wide.withColumn("fresh", F.coalesce((F.col("r0") > before + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("photo_id", "h", "w", "c", "run").agg(F.min("r0").cast("int").alias("r0"), F.max("r1").cast("int").alias("r1")).drop("run")


def labelled(runs: DataFrame) -> DataFrame:
    """``runs`` with the ``label`` of their 8-connected area: the least of its runs, by column and row."""
    named = settled(runs.withColumn("node", F.shiftleft(F.col("c").cast("long"), 32) + F.col("r0")))  # read by nodes and by both ends of edges
    one = named.select("photo_id", "c", F.col("r0").alias("a0"), F.col("r1").alias("a1"), F.col("node").alias("a"))
    next_ = named.select("photo_id", (F.col("c") - 1).alias("c"), F.col("r0").alias("b0"), F.col("r1").alias("b1"), F.col("node").alias("b"))
    edges = one.join(next_, ["photo_id", "c"]).filter("b0 <= a1 + 1 AND a0 <= b1 + 1")
    return settled(named.join(connected(named, edges), ["photo_id", "node"]).drop("node"))


def areas(runs: DataFrame) -> DataFrame:
    """Box and number of pixels of each area of labelled runs."""
    return runs.groupBy("photo_id", "h", "w", "label").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.sum(F.col("r1") - F.col("r0") + 1).alias("pixels"))


def is_line(s: dict) -> Column:
    """Whether an area is tall and narrow enough to be part of a fence."""
    f = s["fence_detection"]
    tall, wide = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    return (tall >= F.col("h") * float(f["min_component_height_ratio"])) & (wide <= F.greatest(F.lit(3.0), F.col("w") * float(f["max_component_width_ratio"]))) & (tall / wide >= float(f["min_component_aspect_ratio"]))


def figures(pixels: DataFrame, persons: DataFrame, s: dict) -> DataFrame:
    """Number of lines, what they cover of the person, the central band and the picture, and the decision, for each person.

    ``persons`` has photo_id, candidate_idx and a box px1, py1, px2, py2 in whole pixels of the picture; ``pixels`` is as in
    :func:`opened_runs`, and a picture without a bright pixel needs none.
    """
    f = s["fence_detection"]
    if not f["enabled"]:
        zero = {n: F.lit(0.0) for n in ("person", "central", "coverage", "fence_score")}
        return persons.select("photo_id", "candidate_idx").withColumns({"lines": F.lit(0), **zero, "fence_detected": F.lit(False)})
    runs = labelled(opened_runs(pixels, s))
    kept = areas(runs).filter(is_line(s)).select("photo_id", "label")
    lines = runs.join(kept, ["photo_id", "label"])
    n, size = F.col("r1") - F.col("r0") + 1, F.col("h").cast("double") * F.col("w")
    band = F.greatest(F.lit(1.0), F.rint(F.col("w") * float(f["central_band_width_ratio"])))
    begin = F.greatest(F.lit(0.0), F.floor((F.col("w") - band) / 2))
    end = F.least(F.col("w"), begin + band)
    middle = F.sum(F.when((F.col("c") >= begin) & (F.col("c") < end), n).otherwise(0))
    whole = lines.groupBy("photo_id", "h", "w").agg(F.count_distinct("label").cast("int").alias("lines"), (F.sum(n) / size).alias("coverage"), (middle / (F.col("h") * (end - begin))).alias("central"))
    over = F.greatest(F.lit(0), F.least(F.col("r1") + 1, F.col("py2")) - F.greatest("r0", "py1"))
    met = persons.join(lines.select("photo_id", "c", "r0", "r1"), "photo_id").filter("c >= px1 AND c < px2")
    met = met.groupBy("photo_id", "candidate_idx").agg(F.sum(over).alias("met"))
    area = F.greatest(F.lit(1.0), ((F.col("px2") - F.col("px1")) * (F.col("py2") - F.col("py1"))).cast("double"))
    out = persons.join(whole.drop("h", "w"), "photo_id", "left").join(met, ["photo_id", "candidate_idx"], "left")
    out = out.select("photo_id", "candidate_idx", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce(F.col("met") / area, F.lit(0.0)).alias("person"), F.coalesce("central", F.lit(0.0)).alias("central"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    fence = S.fence_decision(s, F.col("lines"), F.col("person"), F.col("central"), F.col("coverage"))
    return out.withColumns({"fence_score": fence["score"], "fence_detected": fence["detected"]})
