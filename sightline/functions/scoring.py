"""Score, class and what follows from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.config import FOLDERS
from sightline.functions import geometry as G
from sightline.functions import keypoints as K

#: What fence measurement gives where there is none; the best score follows from it.
NO_FENCE = 0.0


def number(x: float) -> str:
    return f"{float(x)!r}D"


def ramp_text(value: str, low: str, high: str) -> str:
    """0 up to ``low``, 1 from ``high``, straight between; a step where the bounds cross."""
    step = f"CASE WHEN {value} >= {high} THEN 1.0D ELSE 0.0D END"
    return f"CASE WHEN {high} <= {low} THEN {step} ELSE greatest(0.0D, least(({value} - {low}) / nullif({high} - {low}, 0.0D), 1.0D)) END"


def ramp(value: Column, low: Column | float, high: Column | float) -> Column:
    """The same for columns."""
    low, high = (x if isinstance(x, Column) else G.num(x) for x in (low, high))
    span = F.when(high > low, high - low)
    step = F.when(value >= high, 1.0).otherwise(0.0)
    return F.when(high <= low, step).otherwise(G.clamp((value - low) / span, G.num(0), G.num(1)))


def fence_free(fence_score: str) -> str:
    """The part of the score that a fence takes away from, as SQL text."""
    return f"greatest(0.0D, least(1.0D - least(1.0D, {fence_score} / 0.25D), 1.0D))"


def components(s: dict, fence_score: str = "fence_score") -> dict[str, str]:
    """The seven parts of the score as SQL text, each from 0 to 1, in the order in which they are added; needs ``full_frame``, ``points_seen``, ``sharpness``, ``alone`` and ``offsets``."""
    f, q = s["selection_filters"], s["quality_scoring"]
    least_h = f"greatest({number(f['min_box_height_px'])}, h * {number(f['min_height_ratio'])})"
    share = f"greatest(0.0D, least(points_seen / {float(K.POINTS)}D, 1.0D))"
    rest = "greatest(0.0D, least(1.0D - {0}, 1.0D))".format
    of_frame = f"CASE WHEN full_frame THEN greatest(0.65D, {share}) ELSE {share} END" if s["full_frame_runner"]["bypass_min_keypoints"] else share
    return {
        "sharpness": ramp_text("sharpness", number(f["min_sharpness_threshold"]), number(q["excellent_sharpness"])),
        "center": rest("least(1.0D, offsets.max / 0.28D)"),
        "size": f"CASE WHEN full_frame THEN 1.0D ELSE {ramp_text('greatest(1.0D, y2 - y1)', least_h, number(q['ideal_runner_height_px']))} END",
        "keypoints": of_frame,
        "isolation": rest("greatest(alone.of_crop / 0.25D, alone.of_other / 0.75D)"),
        "confidence": ramp_text("conf", number(f["conf_threshold"]), number(q["ideal_confidence"])),
        "fence_free": fence_free(fence_score),
    }


def raw_score(s: dict, parts: dict[str, str]) -> str:
    """The weighted mean in hundredths as SQL text, not rounded; added in a fixed order."""
    weights = s["quality_scoring"]["weights"]
    total, of = "0.0D", 0.0
    for name, part in parts.items():
        weight = float(weights.get(name, 0.0))
        total, of = f"{total} + {part} * {number(weight)}", of + weight
    return f"({total}) / {number(max(0.001, of))} * 100.0D"


def class_text(s: dict, score: str) -> str:
    lines = s["quality_scoring"]["classes"]
    return f"CASE {' '.join(f"WHEN {score} >= {number(lines[n])} THEN '{n}'" for n in ('premium', 'good', 'review'))} ELSE 'reject' END"


def quality_class(s: dict, score: Column) -> Column:
    lines = s["quality_scoring"]["classes"]
    return F.when(score >= float(lines["premium"]), "premium").when(score >= float(lines["good"]), "good").when(score >= float(lines["review"]), "review").otherwise("reject")


def folder(quality: Column) -> Column:
    out = F.when(quality == "premium", FOLDERS["premium"])
    for name in ("good", "review", "reject"):
        out = out.when(quality == name, FOLDERS[name])
    return out.otherwise(FOLDERS["review"])


def saved_text(s: dict, quality: str, score: str) -> str:
    """Whether a class and score are saved, as SQL text."""
    q = s["quality_scoring"]
    if q["premium_only"]:
        return f"({quality} = 'premium')"
    if not q["save_review"]:
        return f"({quality} NOT IN ('reject', 'review'))"
    return f"({quality} <> 'reject' OR {score} >= {number(q['hard_reject_below_score'])})"


def enhancement_text(s: dict) -> str:
    """Why a Review crop looks worth restoring, as SQL text; null if it doesn't."""
    r = s["review_enhancement"]
    return (
        f"CASE WHEN sharpness <= {number(r['candidate_max_sharpness'])} THEN 'soft_focus' WHEN brightness < {number(r['candidate_min_brightness'])} THEN 'underexposed' "
        f"WHEN brightness > {number(r['candidate_max_brightness'])} THEN 'overexposed' END"
    )


def fence_decision(s: dict, lines: Column, person: Column, central: Column, coverage: Column) -> Column:
    """Struct ``detected`` and ``score`` from a crop's measured fence figures."""
    f = s["fence_detection"]
    over = (person >= float(f["reject_person_occlusion_coverage"])) | (central >= float(f["reject_central_occlusion_score"])) | (coverage >= float(f["reject_vertical_line_coverage"]))
    return F.struct(((lines >= int(f["reject_vertical_line_count"])) & over).alias("detected"), F.greatest(person, central, coverage * 1.3).alias("score"))
