"""From detections to decisions: the ordered gates, the score, demotions and what is saved.

``decide`` gives a row per candidate. Everything is a projection or a filter over columns
of the row, and the other detections of a photo come along as an array that is gathered
once per photo, so the only shuffle is that one, by photo. Cheap gates come first in the
``CASE`` chain; with the fast path, candidates that can't be saved are named before the
fence figures are looked at, and a plan that has to compute these filters on
``needs_fence`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import config
from sightline.functions import geometry as G
from sightline.functions import keypoints as K
from sightline.functions import scoring as S


def with_others(dets: DataFrame) -> DataFrame:
    """Adds ``dets``: number and box of all raw detections of the photo, in any order, unless the source brings them.

    A detector gives at most a bounded number per photo, so the arrays are bounded. The window
    uses the same shuffle by photo as what made the detections, and copies whole rows: a source that adds
    keypoints later does better to gather the boxes before.
    """
    if "dets" in dets.columns:
        return dets
    one = F.struct("candidate_idx", "x1", "y1", "x2", "y2")
    return dets.withColumn("dets", F.collect_list(one).over(Window.partitionBy("photo_id")))


def as_rows(df: DataFrame) -> DataFrame:
    """The same rows, as the output of a generator.

    The optimizer puts a later filter below the projections that it reads from, and with
    many of them in a row copies of copies of their expressions. It can't below this one. The photo's number passes beside the generator, so
    that what comes after still knows that rows lie by photo and needs no other shuffle.
    """
    return df.select("photo_id", F.inline(F.array(F.struct(*(n for n in df.columns if n != "photo_id"))))).select(df.columns)


def geometry_gate(s: dict, seen: str | None = None) -> Column:
    """The first gate of position, size and keypoints that a candidate fails; null if none. Needs ``full_frame``; ``seen`` names the number of sure keypoints, if it is known."""
    f, r = s["selection_filters"], s["full_frame_runner"]
    zone, gates = S.number(float(f["safe_zone_percent"]) / 100.0), []
    free = lambda flag: "full_frame" if r[flag] else "false"
    if f["enable_safe_zone"]:
        gates.append(f"WHEN NOT {free('bypass_safe_zone')} AND ((x1 + x2) / 2.0D < w * {zone} OR (x1 + x2) / 2.0D > w * (1.0D - {zone})) THEN 'unsafe_edge'")
    gates.append(f"WHEN NOT full_frame AND y2 - y1 < greatest(h * {S.number(f['min_height_ratio'])}, {S.number(f['min_box_height_px'])}) THEN 'too_small'")
    gates.append(f"WHEN NOT {free('bypass_min_keypoints')} AND {seen or K.count_text(s, tuple(range(K.POINTS)))} < {int(f['min_keypoints'])} THEN 'too_few_keypoints'")
    if f["require_frontal_face"]:
        gates.append(f"WHEN NOT {free('bypass_min_keypoints')} AND NOT ({K.frontal_text()}) THEN 'no_frontal_face'")
    return F.expr(f"CASE {' '.join(gates)} END")


def prepared(dets: DataFrame, s: dict) -> DataFrame:
    """Candidates with ``full_frame``, ``points_seen``, ``gate``, ``complete``, ``crop``, and how it lies: ``alone`` and ``offsets``.

    What is read of the keypoints is read in one projection (the gate of faces, where it is on, comes after), so that later ones needn't carry these if nobody asks for them.
    """
    read = {"full_frame": G.is_full_frame(s), "points_seen": K.visible(s), "complete": K.completeness(s, G.cut_by_frame(s))}
    out = with_others(dets).select("*", *(c.alias(n) for n, c in read.items()), *(F.expr(text).alias(n) for n, text in G.reach(s).items()))
    out = out.withColumn("gate", geometry_gate(s, "points_seen"))
    out = G.with_smart_crop(out, s).withColumn("crop", F.when(F.col("full_frame"), G.full_frame_crop(s)).otherwise(F.col("smart_crop"))).drop("smart_crop")
    return G.with_isolation(out, "alone").withColumn("offsets", G.centre_offsets("crop"))


#: Columns of ``prepared`` that no later stage reads; arrays, which are most of a row's bytes.
DONE = ("kps", "dets", "alone", "offsets")


def scored(prep: DataFrame, s: dict, *, lean: bool = False) -> DataFrame:
    """Adds the parts of the score, the score, and the ``ceiling`` that it would have without a fence. With ``lean`` the columns of ``DONE`` and the parts go."""
    parts = S.components(s)
    out = prep.selectExpr("*", *(f"{text} AS part_{n}" for n, text in parts.items()))
    known = {n: f"part_{n}" for n in parts}
    ceiling = S.raw_score(s, known | {"fence_free": S.fence_free(S.number(S.NO_FENCE))})
    out = out.selectExpr("*", f"{S.raw_score(s, known)} AS raw_score", f"{ceiling} AS raw_ceiling")
    out = out.selectExpr("* EXCEPT (raw_ceiling)", f"{G.rounded_text('raw_ceiling', 2)} AS ceiling", f"{G.rounded_text('raw_score', 2)} AS score")
    return as_rows(out.drop(*DONE, *known.values()) if lean else out)


def decide(dets: DataFrame, s: dict, *, lean: bool = False) -> DataFrame:
    """A row per candidate with ``decision``, ``reason``, class, demotion and output columns.

    With ``lean`` the keypoints, the photo's other detections and the parts of the score, which no decision reads any more, aren't in the result.
    """
    return finished(scored(prepared(dets, s), s, lean=lean), s)


def finished(rows: DataFrame, s: dict) -> DataFrame:
    """The decisions over rows of ``scored``, in stages of SQL text."""
    f, q, guarded = s["selection_filters"], s["quality_scoring"], s["completeness_guard"]
    number, soft_line = S.number, float(f["premium_min_sharpness"])
    soft = f"sharpness < {number(soft_line)}"
    partial = "NOT full_frame AND NOT complete.ok_for_premium"
    why = "coalesce(complete.reason, 'partial_body')"
    class2 = f"CASE WHEN class1 = 'premium' AND {soft} THEN 'good' ELSE class1 END" if soft_line > 0 else "class1"
    to_review = f"{partial} AND class2 IN ('premium', 'good')" if guarded["enabled"] and guarded["review_on_partial"] else "false"
    demoted = f"CASE WHEN {to_review} THEN complete.reason {f"WHEN class1 = 'premium' AND {soft} THEN 'soft_for_premium'" if soft_line > 0 else ''} END"
    gates = [("gate IS NOT NULL", "gate")]
    if (prune := config.may_prune(s)) and guarded["enabled"]:
        gates.append((partial, f"concat('skipped_', {why})"))
    # the last two: a photo without pixels
    gates.append(("NOT full_frame AND (crop.x2 <= crop.x1 OR crop.y2 <= crop.y1 OR crop.x1 >= w OR crop.y1 >= h)", "'crop_failed'"))
    if f["hard_reject_extreme_blur"]:
        gates.append((f"sharpness < {number(f['min_sharpness_threshold'])}", "'blurred'"))
    if prune and q["premium_only"] and soft_line > 0:
        gates.append((soft, "'skipped_soft'"))
    if prune:
        gates.append((f"ceiling < {number(config.saveable_floor(s))}", "'skipped_score'"))
    if f["hard_reject_fence"]:
        gates.append(("fence_detected", "'fence_detected'"))
    if guarded["enabled"] and not guarded["review_on_partial"]:
        gates.append((partial, why))
    gates.append((f"NOT {S.saved_text(s, 'graded', 'score')}", "'low_quality_score'"))
    reason = f"CASE {' '.join(f'WHEN {test} THEN {said}' for test, said in gates)} ELSE 'ok' END"
    measured = "reason NOT IN ('unsafe_edge', 'too_small', 'too_few_keypoints', 'no_frontal_face', 'crop_failed', 'blurred', 'fence_detected') AND NOT startswith(reason, 'skipped_')"
    accepted = "reason = 'ok'"
    final = "CASE WHEN graded = 'reject' THEN 'review' ELSE graded END"
    worth = f"CASE WHEN {accepted} AND quality_class = 'review' THEN {S.enhancement_text(s)} END" if "brightness" in rows.columns else "CAST(NULL AS STRING)"
    modes = "".join(f" WHEN '{name}' THEN '{mode}'" for name, mode in s["image_quality"]["enhance_by_class"].items())
    folders = "".join(f" WHEN '{name}' THEN '{folder}'" for name, folder in config.FOLDERS.items())
    name = (
        f"format_string('%s/%s_runner%02d_q%d_s%d_c%d.jpg', CASE quality_class{folders} ELSE '{config.FOLDERS['review']}' END, string(photo_id), candidate_idx, "
        "int(rint(score)), int(rint(sharpness)), int(rint(conf * 100)))"
    )
    rows = rows.selectExpr("*", f"{S.class_text(s, 'score')} AS class1").selectExpr("*", f"{class2} AS class2")
    rows = rows.selectExpr("*", f"CASE WHEN {to_review} THEN 'review' ELSE class2 END AS graded", f"{demoted} AS demoted").selectExpr("*", f"{reason} AS reason")
    rows = rows.selectExpr(
        "*", f"CASE WHEN {accepted} THEN 'accept' ELSE 'reject' END AS decision", f"CASE WHEN {measured} THEN CASE WHEN {accepted} THEN {final} ELSE graded END END AS quality_class",
        f"CASE WHEN {measured} THEN demoted END AS demoted_reason",
    )
    return rows.selectExpr("*", f"{worth} AS enhancement_reason", f"CASE WHEN {accepted} THEN CASE quality_class{modes} ELSE 'upscale' END END AS enhance_mode", f"CASE WHEN {accepted} THEN {name} END AS output_name")


def needs_fence(s: dict) -> Column:
    """Over ``scored`` rows (fence figures not needed): whether the fence can still matter."""
    f, q, least = s["selection_filters"], s["quality_scoring"], float(s["selection_filters"]["premium_min_sharpness"])
    out = F.col("gate").isNull() & ~(F.lit(bool(f["hard_reject_extreme_blur"])) & (F.col("sharpness") < float(f["min_sharpness_threshold"])))
    if config.may_prune(s):
        guard = F.lit(bool(s["completeness_guard"]["enabled"])) & ~F.col("full_frame")
        out = out & ~(guard & ~F.col("complete.ok_for_premium")) & (F.col("ceiling") >= float(config.saveable_floor(s)))
        if q["premium_only"] and least > 0:
            out = out & (F.col("sharpness") >= least)
    return out


def reject_name(reason: Column) -> Column:
    """A reason as part of a file name."""
    return F.substring(F.regexp_replace(reason, r"[^\p{L}\p{N}._-]", "_"), 1, 60)


def fallback(photos: DataFrame, decisions: DataFrame, s: dict) -> DataFrame:
    """Photos without an accepted candidate, and whether they are kept as a whole. ``photos`` has sharpness and fence figures of the whole photo."""
    b = s["whole_image_fallback"]
    if not b["enabled"]:
        return photos.limit(0).select("photo_id", F.lit("").alias("after"), F.lit("").alias("decision"), F.lit("").alias("reason"), F.lit(0.0).alias("score"))
    seen = decisions.groupBy("photo_id").agg(F.max(F.col("decision") == "accept").alias("accepted"))
    left = photos.join(seen, "photo_id", "left").filter(~F.coalesce("accepted", F.lit(False)))
    after, quality = F.when(F.col("accepted").isNotNull(), "no_accepted_candidates").otherwise("no_person"), str(b["save_class"])
    reason = F.when(F.lit(bool(s["quality_scoring"]["premium_only"]) and quality != "premium"), F.lit(f"fallback_class_{quality}_not_saved_premium_only"))
    reason = reason.when(F.col("photo_sharpness") < float(b["min_original_sharpness"]), F.concat(F.lit("fallback_too_soft_after_"), after))
    reason = reason.when(F.lit(bool(b["reject_if_fence"])) & F.col("photo_fence"), F.concat(F.lit("fallback_fence_after_"), after)).otherwise(F.concat(F.lit("fallback_after_"), after))
    out = left.select("photo_id", after.alias("after"), reason.alias("reason"))
    decision = F.when(F.col("reason") == F.concat(F.lit("fallback_after_"), F.col("after")), "accept").otherwise("reject")
    return out.select("photo_id", "after", decision.alias("decision"), "reason", F.lit(50.0 if quality == "review" else 65.0).alias("score"))


def counters(decisions: DataFrame) -> DataFrame:
    """How often each outcome occurs; derived from the decisions, so task retries can't count twice."""
    return decisions.groupBy("decision", "reason", "quality_class").agg(F.count("*").alias("n"))


# The names of the counters of a run, in the order in which they are told.
TALLY = (
    "total_images", "pre_check_rejected", "images_with_person", "processed_crops", "quality_premium", "quality_good", "quality_review", "fallback_saved",
    "no_person", "too_small", "unsafe_edge", "bad_pose", "blurred", "fence_rejected", "low_quality_score", "crop_failed",
    "demoted_partial", "demoted_soft", "partial_body", "truncated_frame", "write_failed", "errors",
)
_PARTIAL = ("partial_body", "partial_lower_body", "truncated_head", "truncated_side", "no_upper_body", "no_lower_body")


def tally(decisions: DataFrame, photos: DataFrame, rejects: DataFrame | None = None, kept_whole: DataFrame | None = None) -> DataFrame:
    """``counter`` and ``n`` for each name in ``TALLY``, from rows that are already decided.

    ``photos`` has a row per photo, ``rejects`` those stopped before detection (``pixels.photo_rejects``), ``kept_whole`` the
    fallback's rows. Each input is aggregated once.
    """
    accepted, reason, class_ = F.col("decision") == "accept", F.col("reason"), F.col("quality_class")
    by_guard = ~accepted & reason.isin(*_PARTIAL)
    of_candidates = {
        "processed_crops": accepted, **{f"quality_{c}": accepted & (class_ == c) for c in ("premium", "good", "review")},
        **{n: reason == n for n in ("too_small", "unsafe_edge", "blurred", "low_quality_score", "crop_failed", "write_failed")},
        "bad_pose": reason.isin("too_few_keypoints", "no_frontal_face"), "fence_rejected": reason == "fence_detected",
        "demoted_soft": class_.isNotNull() & (F.col("class1") == "premium") & (F.col("class2") == "good"),
        "demoted_partial": F.col("demoted_reason").isNotNull() & (F.col("demoted_reason") != "soft_for_premium"),
        "truncated_frame": by_guard & F.col("complete.truncated_top"), "partial_body": by_guard & ~F.col("complete.truncated_top"),
    }
    parts = [decisions.agg(*(F.count_if(c).alias(n) for n, c in of_candidates.items()), F.count_distinct("photo_id").alias("images_with_person")), photos.agg(F.count("*").alias("total_images"))]
    if rejects is not None:
        parts.append(rejects.agg(F.count_if(reason == "pre_check_failed").alias("pre_check_rejected"), F.count_if(reason != "pre_check_failed").alias("errors")))
    if kept_whole is not None:
        saved_class = F.when(F.col("score") == 50.0, "review").otherwise("good")
        whole = {"fallback_saved": accepted, "fallback_fence": reason.startswith("fallback_fence_"), **{f"whole_{c}": accepted & (saved_class == c) for c in ("good", "review")}}
        parts.append(kept_whole.agg(*(F.count_if(c).alias(n) for n, c in whole.items())))
    row = parts[0]
    for part in parts[1:]:
        row = row.join(part)  # one row each
    known = set(row.columns)
    value = {n: F.col(n) if n in known else F.lit(0) for n in TALLY}
    value["no_person"] = F.col("total_images") - F.col("images_with_person") - value["pre_check_rejected"] - value["errors"]
    if kept_whole is not None:
        value |= {"processed_crops": value["processed_crops"] + F.col("fallback_saved"), "fence_rejected": value["fence_rejected"] + F.col("fallback_fence")}
        value |= {f"quality_{c}": value[f"quality_{c}"] + F.col(f"whole_{c}") for c in ("good", "review")}
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("counter"), value[n].cast("long").alias("n")) for n in TALLY))).alias("t")).select("t.*")


def post_processing(decisions: DataFrame, s: dict) -> DataFrame:
    """Adds to accepted crops whether they are upscaled (small ones, by their class' mode) and whether denoising and sharpening follow."""
    q = s["image_quality"]
    small = (F.col("crop.y2") - F.col("crop.y1")) < int(q["ai_upscaling_limit"])
    polish = (F.col("quality_class") != "premium") | F.lit(bool(q["post_process_premium"]))
    return decisions.filter(F.col("decision") == "accept").withColumns({"upscaled": (F.col("enhance_mode") != "none") & small, "restored_face": (F.col("enhance_mode") == "upscale+face") & small, "post_processed": polish})


def second_pass(decisions: DataFrame) -> DataFrame:
    """Saved crops of class review that a second enhancement goes over: those promising, or all where none is.

    Whether one is promising is asked once for the whole table (a scalar subquery), so ``decisions`` is best a written table.
    """
    review = decisions.filter((F.col("decision") == "accept") & (F.col("quality_class") == "review"))
    promising = F.col("enhancement_reason").isNotNull()
    return review.filter(promising | ~review.filter(promising).exists())


def report(decisions: DataFrame) -> DataFrame:
    """The fixed columns of the report, in a fixed order of rows."""
    c = F.col("complete")
    return decisions.select(
        "photo_id", "candidate_idx", G.rounded(F.col("conf"), 4).alias("confidence"), *(G.rounded(F.col(x), 1).alias(f"box_{x}") for x in ("x1", "y1", "x2", "y2")),
        G.rounded(G.box_height(), 1).alias("box_height"), "full_frame", "decision", "reason", G.rounded(F.col("sharpness"), 2).alias("sharpness"),
        F.when(F.col("quality_class").isNotNull(), F.col("score")).alias("quality_score"), "quality_class", "demoted_reason",
        c["completeness"].alias("completeness"), c["has_upper_body"].alias("has_upper_body"), c["truncated_top"].alias("truncated_top"), "enhancement_reason", "enhance_mode", "output_name",
    ).orderBy("photo_id", "candidate_idx")


def report_columns(decisions: DataFrame, s: dict) -> DataFrame:
    """The candidates' columns of the report by the names of its header."""
    c, crop = F.col("complete"), F.col("crop")
    boxes = {f"box_{x}": G.rounded(F.col(x), 1) for x in ("x1", "y1", "x2", "y2")} | {f"crop_{x}": G.rounded(crop[x], 1) for x in ("x1", "y1", "x2", "y2")}
    return decisions.select(
        "photo_id", "candidate_idx", G.rounded(F.col("conf"), 4).alias("confidence"), *(v.alias(n) for n, v in boxes.items()), G.rounded(G.box_height(), 1).alias("box_height"),
        F.col("full_frame").alias("is_full_frame"), "decision", "reason", (F.col("points_seen") if "points_seen" in decisions.columns else K.visible(s)).alias("visible_keypoints"), G.rounded(F.col("sharpness"), 2).alias("sharpness"), "fence_detected", G.rounded(F.col("fence_score"), 4).alias("fence_score"),
        F.col("score").alias("quality_score"), "quality_class", "demoted_reason", c["completeness"].alias("completeness"), c["has_upper_body"].alias("has_upper_body"), c["truncated_top"].alias("truncated_top"),
        F.col("enhancement_reason").alias("enhancement_candidate_reason"), "enhance_mode", F.col("output_name").alias("output_path"),
    )
