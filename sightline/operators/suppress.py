"""Suppression of detections that overlap a surer one of the same photo."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2)."""
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    tall = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.when((wide > 0) & (tall > 0), wide * tall).otherwise(0.0)
    areas = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    return inter / F.greatest(F.lit(1e-9), areas - inter)


def surest_first(dets: Column) -> Column:
    """An array of detections by falling confidence; equal ones stay in their order, a null confidence counts as 1."""
    sure = lambda d: F.coalesce(d["conf"], F.lit(1.0))
    keyed = F.transform(dets, lambda d, i: F.struct((-sure(d)).alias("k"), i.alias("i"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda x: x["d"])


def suppressed(dets: Column, s: dict, kind: str) -> Column:
    """Detections sure enough, without those that overlap a surer one that stays; at most ``max_det``, surest first.

    ``kind`` is the array's type as text. The fold's state is what stays so far, so its work is bounded by ``max_det`` times the
    photo's detections.
    """
    d, least = s["detector"], float(s["selection_filters"]["conf_threshold"])
    sure = F.filter(dets, lambda x: F.coalesce(x["conf"], F.lit(1.0)) >= least)
    most, limit = int(d["max_det"]), float(d["iou"])

    def step(kept: Column, x: Column) -> Column:
        full = F.size(kept) >= most
        return F.when(full | F.exists(kept, lambda k: overlap(k["box"], x["box"]) > limit), kept).otherwise(F.concat(kept, F.array(x)).cast(kind))

    return F.aggregate(surest_first(sure), F.array().cast(kind), step)
