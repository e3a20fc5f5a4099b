"""Expressions over a candidate's keypoints: ``kps``, an array of up to 17 of struct<x, y, conf>, which may be null.

They are given as SQL text: built call by call, the many terms over single keypoints took
most of the time in which a plan was made.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# COCO-17 groups.
HEAD, SHOULDERS, HIPS, KNEES, ANKLES = (0, 1, 2, 3, 4), (5, 6), (11, 12), (13, 14), (15, 16)
TORSO = (0, 1, 2, 5, 6, 11, 12)
POINTS = 17


def _sure(s: dict, i: int) -> str:
    return f"coalesce(get(kps, {i}).conf > {float(s['selection_filters']['keypoint_conf'])!r}D, false)"


def seen(s: dict, i: int) -> Column:
    """Whether keypoint i is there and sure enough."""
    return F.expr(_sure(s, i))


def any_seen(s: dict, group: tuple[int, ...]) -> Column:
    return F.expr(" or ".join(_sure(s, i) for i in group))


def count_text(s: dict, group: tuple[int, ...]) -> str:
    """How many of the group are sure enough. A sum over their places: arrays' higher-order functions would be interpreted."""
    return " + ".join(f"int({_sure(s, i)})" for i in group)


def count_seen(s: dict, group: tuple[int, ...]) -> Column:
    return F.expr(count_text(s, group))


def visible(s: dict) -> Column:
    """How many keypoints are sure enough."""
    return count_seen(s, tuple(range(POINTS)))


def along(s: dict, axis: str, group: tuple[int, ...]) -> list[str]:
    """The coordinates of the group's keypoints as SQL text, null where one isn't sure."""
    return [f"(case when {_sure(s, i)} then get(kps, {i}).{axis} end)" for i in group]


def least(values: list[str]) -> Column:
    """The least of those that are there; null if none is."""
    return F.expr(f"least({', '.join(values)})" if len(values) > 1 else values[0])


def greatest(values: list[str]) -> Column:
    return F.expr(f"greatest({', '.join(values)})" if len(values) > 1 else values[0])


def mean_text(values: list[str]) -> str:
    """Mean of the one or two values that are there; null if none is."""
    one, two = values
    return f"coalesce(({one} + {two}) / 2.0D, {one}, {two})"


def frontal_text() -> str:
    def over(i: int, least: float) -> str:
        return f"coalesce(get(kps, {i}).conf > {least!r}D, false)"

    return f"kps is null or ({over(0, 0.45)} and ({over(1, 0.35)} or {over(2, 0.35)}))"


def completeness(s: dict, cut_side: Column) -> Column:
    """Struct: which parts of a person are there, and why not to grade it Premium or Good."""
    g = s["completeness_guard"]
    head, hips, legs = any_seen(s, HEAD), any_seen(s, HIPS), any_seen(s, KNEES + ANKLES)
    upper, lower = head | (seen(s, 5) & seen(s, 6)), hips | legs
    zones = [head, any_seen(s, SHOULDERS), hips, any_seen(s, KNEES), any_seen(s, ANKLES)]
    share = sum((z.cast("int") for z in zones), F.lit(0)) / 5.0
    top = F.lit(bool(g["truncation_guard"])) & (F.col("y1") <= float(g["edge_margin_px"]))
    missing = (F.lit(bool(g["require_upper_body"])) & ~upper) | (F.lit(bool(g["require_lower_body"])) & ~lower) | top
    reason = F.when(lower & ~upper, "partial_lower_body").when(top, "truncated_head").when(~upper, "no_upper_body").when(~lower, "no_lower_body")
    return F.struct(
        (~(missing | cut_side)).alias("ok_for_premium"),
        F.when(cut_side & ~missing, F.lit("truncated_side")).otherwise(reason).alias("reason"),
        F.round(share, 3).alias("completeness"), head.alias("has_head"), upper.alias("has_upper_body"), lower.alias("has_lower_body"),
        (lower & ~upper).alias("partial_lower_body"), top.alias("truncated_top"),
        ((F.col("y2") >= F.col("h") - float(g["edge_margin_px"])) & ~legs).alias("truncated_bottom"), cut_side.alias("truncated_side"),
    )
