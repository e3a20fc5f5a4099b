"""Boxes and crops as column expressions.

A candidate has its photo's ``w`` and ``h``, its box ``x1 y1 x2 y2`` and ``kps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import keypoints as K


def clamp(value: Column, low: Column, high: Column) -> Column:
    """``low`` wins where the bounds cross."""
    return F.greatest(low, F.least(value, high))


def num(x: float) -> Column:
    return F.lit(float(x))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many decimals by its binary value, halves to even; ``F.round`` goes by the shortest decimal.

    The product with the power of ten is split so that what its rounding loses is known exactly.
    """
    scale = float(10**digits)
    product = x * scale
    wide = x * 134217729.0
    high = wide - (wide - x)
    lost = (high * scale - product) + (x - high) * scale
    low = F.floor(product).cast("double")
    over = (product - low - 0.5) + lost
    up = (over > 0) | ((over == 0) & (low % 2.0 != 0))
    return F.when(up, low + 1.0).otherwise(low) / scale


def rounded_text(x: str, digits: int) -> str:
    """The same for a column, as SQL text."""
    scale = f"{float(10**digits)!r}D"
    product, low = f"({x} * {scale})", f"double(floor({x} * {scale}))"
    high = f"({x} * 134217729.0D - ({x} * 134217729.0D - {x}))"
    over = f"(({product} - {low} - 0.5D) + (({high} * {scale} - {product}) + ({x} - {high}) * {scale}))"
    return f"(CASE WHEN {over} > 0 OR ({over} = 0 AND {low} % 2.0D <> 0) THEN {low} + 1.0D ELSE {low} END) / {scale}"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def box_height() -> Column:
    return F.col("y2") - F.col("y1")


def _cut_text(s: dict, top: bool = False) -> str:
    g = s["completeness_guard"]
    if not g["edge_truncation_guard"]:
        return "false"
    margin = f"{float(g['edge_margin_px'])!r}D"
    return f"(x1 <= {margin} OR x2 >= w - {margin}{f' OR y1 <= {margin}' if top else ''})"


def cut_by_frame(s: dict, top: bool = False) -> Column:
    """Whether the box runs into the left or right border, or, with ``top``, into the upper one."""
    return F.expr(_cut_text(s, top))


def is_full_frame(s: dict) -> Column:
    """Whether a person fills the frame, by height or area, without being cut."""
    f = s["full_frame_runner"]
    if not f["enabled"]:
        return F.lit(False)
    tall = f"(y2 - y1) / greatest(1.0D, h) >= {float(f['trigger_box_height_ratio'])!r}D"
    area = f"(x2 - x1) * (y2 - y1) / greatest(1.0D, w * h) >= {float(f['trigger_box_area_ratio'])!r}D"
    return F.expr(f"NOT {_cut_text(s, top=True)} AND ({tall} OR {area})")


def full_frame_crop(s: dict) -> Column:
    """The largest crop of the wanted aspect around the box's centre, inside the photo; whole pixels, halves to even. The photo itself where crops keep its shape."""
    whole = _box_text("0", "0", "w", "h")
    if not s["full_frame_runner"]["crop_to_aspect_ratio"]:
        return F.expr(whole)
    ratio = f"{float(s['crop']['aspect_ratio'])!r}D"
    now = "(double(w) / greatest(1.0D, double(h)))"
    wide = f"{now} > {ratio}"
    cw, ch = _case(wide, f"double(h) * {ratio}", "double(w)"), _case(wide, "double(h)", f"double(w) / {ratio}")
    x = f"greatest(0.0D, least({_case(wide, f'(x1 + x2) / 2.0D - ({cw}) / 2.0D', '0.0D')}, greatest(0.0D, double(w) - ({cw}))))"
    y = f"greatest(0.0D, least({_case(wide, '0.0D', f'(y1 + y2) / 2.0D - ({ch}) / 2.0D')}, greatest(0.0D, double(h) - ({ch}))))"
    fitted = _box_text(f"rint({x})", f"rint({y})", f"rint({x} + ({cw}))", f"rint({y} + ({ch}))")
    return F.expr(_case(f"abs({now} - {ratio}) < 0.01D", whole, fitted))


def _stages(df: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """Adds columns, given as SQL text, stage by stage; what several later columns use is then computed once, not inlined in each."""
    for stage in stages:
        df = df.selectExpr("*", *(f"{text} AS {name}" for name, text in stage.items()))
    return df


def _case(condition: str, yes: str, no: str) -> str:
    return f"CASE WHEN {condition} THEN {yes} ELSE {no} END"


def _box_text(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"named_struct('x1', double({x1}), 'y1', double({y1}), 'x2', double({x2}), 'y2', double({y2}))"


def reach(s: dict) -> dict[str, str]:
    """All that the anatomy crop reads of the keypoints, as SQL text: the box widened to the sure ones, if these are enough, and where parts of the body lie."""
    every = tuple(range(K.POINTS))
    enough, reach = f"{K.count_text(s, every)} >= {int(s['selection_filters']['min_keypoints'])}", {}
    for side, axis, pick in (("x1", "x", "least"), ("y1", "y", "least"), ("x2", "x", "greatest"), ("y2", "y", "greatest")):
        reach[f"_{side}"] = _case(enough, f"{pick}({side}, {pick}({', '.join(K.along(s, axis, every))}))", side)  # both skip nulls
    reach |= {"_head_y": f"least({', '.join(K.along(s, 'y', K.HEAD))})"} | {f"_{n}_y": K.mean_text(K.along(s, "y", g)) for n, g in (("shoulder", K.SHOULDERS), ("hip", K.HIPS))}
    return reach | {f"_low_{n}": f"greatest({', '.join(K.along(s, 'y', g))})" for n, g in (("hip", K.HIPS), ("knee", K.KNEES), ("ankle", K.ANKLES))}


def with_anatomy(df: DataFrame, s: dict) -> DataFrame:
    """Adds ``anatomy``: a crop from head to foot with margins, whose width follows from the aspect ratio.

    The terms are SQL text, as those over keypoints are: built call by call they took seconds of a plan. Columns of :func:`reach` that are there already are used up.
    """
    c, read = s["crop"], reach(s)
    d = {n: f"{float(v)!r}D" for n, v in c.items() if isinstance(v, (int, float))}
    estimate = f"{float(s['completeness_guard']['head_estimate_ratio'])!r}D"
    scale = {"_tall": "greatest(1.0D, _y2 - _y1)", "_torso": "CASE WHEN _hip_y > _shoulder_y THEN _hip_y - _shoulder_y END"}
    above = f"coalesce(_head_y - _tall * {d['anatomy_crown_allowance']}, _shoulder_y - _tall * {estimate})"
    below = "{0} + coalesce(_torso * {1}, _tall * {2})".format
    feet = f"coalesce(_low_ankle, {below('_low_knee', d['anatomy_shank_to_torso_ratio'], d['anatomy_knee_extend_ratio'])}, {below('_low_hip', d['anatomy_leg_to_torso_ratio'], d['anatomy_hip_extend_ratio'])})"
    ends = {"_top0": f"least(_y1, {above})", "_foot": f"greatest(_y2, {feet})"}
    person = "greatest(1.0D, _foot - _top0)"
    side = f"{1.0 + float(c['anatomy_side_margin'])!r}D"
    margins = {"_top": f"_top0 - {person} * {d['anatomy_headroom_ratio']}", "_low": f"_foot + {person} * {d['anatomy_footroom_ratio']}", "_need": f"(_x2 - _x1) * {side}", "_middle": "(_x1 + _x2) / 2.0D"}
    framed, ratio = f"(_low - _top) * {d['aspect_ratio']}", d["aspect_ratio"]
    width = {"_width": _case(f"{framed} < _need", "_need", framed), "_bottom": _case(f"{framed} < _need", f"_top + _need / {ratio}", "_low")}
    crop = {"anatomy": _box_text("_middle - _width / 2.0D", "_top", "_middle + _width / 2.0D", "_bottom")}
    kept = [n for n in df.columns if n != "anatomy" and n not in read]
    begun = df.drop("anatomy") if set(read) <= set(df.columns) else _stages(df.select(*kept), read)
    return _stages(begun, scale, ends, margins, width, crop).select(*kept, "anatomy")


def with_smart_crop(df: DataFrame, s: dict, name: str = "smart_crop") -> DataFrame:
    """Adds the anatomy crop, cut to whole pixels inside the photo."""
    begin = {"_cx1": "int(greatest(0.0D, least(anatomy.x1, w - 1.0D)))", "_cy1": "int(greatest(0.0D, least(anatomy.y1, h - 1.0D)))"}
    x2, y2 = "int(greatest(_cx1 + 1.0D, least(anatomy.x2, double(w))))", "int(greatest(_cy1 + 1.0D, least(anatomy.y2, double(h))))"
    return _stages(with_anatomy(df, s), begin, {name: _box_text("_cx1", "_cy1", x2, y2)}).drop("_cx1", "_cy1", "anatomy")


def centre_offsets(crop: str = "crop") -> Column:
    """How far a crop column's centre lies from the box's, as shares of the crop."""
    x, y = (f"abs(({v}1 + {v}2) / 2.0D - ({crop}.{v}1 + {crop}.{v}2) / 2.0D) / greatest(1.0D, {crop}.{v}2 - {crop}.{v}1)" for v in "xy")
    return F.expr(f"named_struct('x', {x}, 'y', {y}, 'max', greatest({x}, {y}))")


#: Detections of a photo that are told apart by their places in compiled code; functions of arrays, which take any number, are interpreted.
FEW = 8


def with_isolation(df: DataFrame, name: str, crop: str = "crop") -> DataFrame:
    """Adds the largest overlap of a crop column with any other raw detection of the photo (``dets``): as share of the crop, and of the other."""

    def met(d: str) -> str:
        wide, tall = (f"(least({crop}.{v}2, {d}.{v}2) - greatest({crop}.{v}1, {d}.{v}1))" for v in "xy")
        return f"CASE WHEN {wide} > 0 AND {tall} > 0 AND {d}.candidate_idx <> candidate_idx THEN {wide} * {tall} ELSE 0.0D END"

    area = "greatest(1.0D, ({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))".format
    places = [f"get(dets, {i})" for i in range(FEW)]
    meetings = {f"_met{i}": met(d) for i, d in enumerate(places)}
    few = {"of_crop": f"greatest({', '.join(meetings)}) / {area(crop)}", "of_other": f"greatest({', '.join(f'_met{i} / {area(d)}' for i, d in enumerate(places))})"}
    every = {"of_crop": f"{met('d')} / {area(crop)}", "of_other": f"{met('d')} / {area('d')}"}
    most = [f"'{n}', CASE WHEN size(dets) <= {FEW} THEN {few[n]} ELSE coalesce(array_max(transform(dets, d -> {every[n]})), 0.0D) END" for n in few]
    return _stages(df, meetings, {name: f"named_struct({', '.join(most)})"}).drop(*meetings)


def final_size(s: dict, crop: Column) -> Column:
    """What is trimmed of a crop for the aspect ratio, and the size it is written in."""
    ratio, target = float(s["crop"]["aspect_ratio"]), int(s["image_quality"]["target_height"])
    w, h = crop["x2"] - crop["x1"], crop["y2"] - crop["y1"]
    wide = w / F.greatest(num(1), h) > ratio
    keep_w = F.when(wide, F.greatest(num(1), F.rint(h * ratio))).otherwise(w)
    keep_h = F.when(wide, h).otherwise(F.least(h, F.greatest(num(1), F.rint(w / ratio))))
    top = clamp(F.rint((h - keep_h) * float(s["crop"]["vertical_trim_top_fraction"])), num(0), h - keep_h)
    return F.struct(F.floor((w - keep_w) / 2).cast("double").alias("left"), top.alias("top"), keep_w.alias("width"), keep_h.alias("height"), F.lit(int(round(target * ratio))).alias("out_width"), F.lit(target).alias("out_height"))


def subject_region(s: dict) -> Column:
    """Head and torso by their sure keypoints, padded; the upper 65 % of the box if these are under three."""
    xs, ys = K.along(s, "x", K.TORSO), K.along(s, "y", K.TORSO)
    n = K.count_seen(s, K.TORSO)
    left, right, top, low = K.least(xs), K.greatest(xs), K.least(ys), K.greatest(ys)
    px, py = F.greatest((right - left) * 0.05, box_height() * 0.02), F.greatest((low - top) * 0.08, box_height() * 0.02)
    around = box(left - px, top - py, right + px, low + py)
    return F.when(n >= 3, around).otherwise(box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y1") + box_height() * 0.65))
