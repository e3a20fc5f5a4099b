"""Registered queries of the selection engine, each with DuckDB text for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import config
from sightline.functions import geometry as G
from sightline.functions import keypoints as K
from sightline.functions import scoring as S
from sightline.operators import decide as D
from sightline.operators import pixels as P
from sightline.operators.tables import settled
from sightline.plans.oracle_base import BASE, decided
from sightline.sources import fixture
from sightline.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ("photo_id", "candidate_idx")
SETTINGS = config.merged(None)
SLOW = config.merged({"performance": {"fast_path": False}})
PREMIUM = config.merged({"quality_scoring": {"premium_only": True}})
REVIEW = config.merged({"quality_scoring": {"save_review": True}})
FALLBACK = config.merged({"whole_image_fallback": {"enabled": True}})


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _box(column: str) -> list:
    return [F.col(column)[x].alias(f"crop_{x}") for x in ("x1", "y1", "x2", "y2")]


def _dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.detections(spark, sf_dir)


@query(f"{decided()} SELECT reason, coalesce(quality_class, 'none') AS quality_class, count(*) AS n FROM decided GROUP BY ALL")
def flagship_reason_class(spark, sf_dir):
    rows = D.decide(_dets(spark, sf_dir), SETTINGS, lean=True)
    return rows.groupBy("reason", F.coalesce("quality_class", F.lit("none")).alias("quality_class")).agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT photo_id, candidate_idx, x1, y1, x2, y2, conf, sharpness, n_seen::INT AS visible_keypoints FROM f")
def source_detections(spark, sf_dir):
    return _dets(spark, sf_dir).select(*KEY, "x1", "y1", "x2", "y2", "conf", "sharpness", K.visible(SETTINGS).alias("visible_keypoints"))


@query(f"{BASE} SELECT photo_id, candidate_idx, cut_side, cut_side OR cut_top AS cut_any FROM f")
def cut_by_frame(spark, sf_dir):
    return _dets(spark, sf_dir).select(*KEY, G.cut_by_frame(SETTINGS).alias("cut_side"), G.cut_by_frame(SETTINGS, top=True).alias("cut_any"))


@query(f"{BASE} SELECT photo_id, candidate_idx, full_frame FROM f")
def full_frame(spark, sf_dir):
    return _dets(spark, sf_dir).select(*KEY, G.is_full_frame(SETTINGS).alias("full_frame"))


def _gate(name: str, f):
    f.__name__ = f"gate_{name}"
    condition = {
        "safe_zone": "NOT full_frame AND ((x1 + x2) / 2 < w * 0.12 OR (x1 + x2) / 2 > w * 0.88)",
        "size": "NOT full_frame AND y2 - y1 < greatest(h * 0.15, 220)",
        "keypoints": "NOT full_frame AND n_seen < 4",
        "frontal": "NOT full_frame AND NOT (v[1] AND (v[2] OR v[3]))",
    }[name]
    return query(f"{BASE} SELECT photo_id, candidate_idx FROM f WHERE {condition}")(f)


def _fails_only(over: dict, reason: str):
    """Candidates that fail one gate while the others are off."""
    off = {"selection_filters": {"enable_safe_zone": False, "min_height_ratio": 0.0, "min_box_height_px": 0, "min_keypoints": 0}}
    s = config.merged(over, config.merged(off))

    def run(spark, sf_dir):
        rows = _dets(spark, sf_dir).withColumn("full_frame", G.is_full_frame(s))
        return rows.filter(D.geometry_gate(s) == reason).select(*KEY)

    return run


_gate("safe_zone", _fails_only({"selection_filters": {"enable_safe_zone": True}}, "unsafe_edge"))
_gate("size", _fails_only({"selection_filters": {"min_height_ratio": 0.15, "min_box_height_px": 220}}, "too_small"))
_gate("keypoints", _fails_only({"selection_filters": {"min_keypoints": 4}}, "too_few_keypoints"))
_gate("frontal", _fails_only({"selection_filters": {"require_frontal_face": True}}, "no_frontal_face"))


@query(f"{BASE} SELECT coalesce(gate, CASE WHEN NOT full_frame AND NOT whole THEN part_reason END, CASE WHEN sharpness < 80 THEN 'blurred' ELSE 'measured' END) AS first_reason, full_frame, count(*) AS n FROM f GROUP BY ALL")
def reason_ladder(spark, sf_dir):
    rows = _dets(spark, sf_dir).withColumn("full_frame", G.is_full_frame(SETTINGS)).withColumn("complete", K.completeness(SETTINGS, G.cut_by_frame(SETTINGS)))
    part = F.when(~F.col("full_frame") & ~F.col("complete.ok_for_premium"), F.col("complete.reason"))
    reason = F.coalesce(D.geometry_gate(SETTINGS), part, F.when(F.col("sharpness") < 80, "blurred").otherwise("measured"))
    return rows.groupBy(reason.alias("first_reason"), "full_frame").agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT photo_id, candidate_idx, whole AS ok_for_premium, part_reason AS reason, completeness, head AS has_head, upper_ok AS has_upper_body, lower_ok AS has_lower_body, lower_ok AND NOT upper_ok AS partial_lower_body, cut_top AS truncated_top, y2 >= h - 6 AND NOT (knees OR ankles) AS truncated_bottom, cut_side AS truncated_side FROM f")
def completeness(spark, sf_dir):
    return _dets(spark, sf_dir).select(*KEY, K.completeness(SETTINGS, G.cut_by_frame(SETTINGS)).alias("c")).select(*KEY, "c.*")


@query(f"{BASE} SELECT photo_id, candidate_idx, round_even(fx1, 0) AS crop_x1, 0.0::DOUBLE AS crop_y1, round_even(fx1 + h * 0.666::DOUBLE, 0) AS crop_x2, h AS crop_y2 FROM f")
def aspect_crop(spark, sf_dir):
    return _dets(spark, sf_dir).withColumn("crop", G.full_frame_crop(SETTINGS)).select(*KEY, *_box("crop"))


@query(f"{BASE} SELECT photo_id, candidate_idx, round(a_cx - a_w / 2, 6) AS crop_x1, round(a_top, 6) AS crop_y1, round(a_cx + a_w / 2, 6) AS crop_x2, round(a_bottom, 6) AS crop_y2 FROM f")
def anatomy_crop(spark, sf_dir):
    rows = G.with_anatomy(_dets(spark, sf_dir), SETTINGS)
    return rows.select(*KEY, *(F.round(F.col("anatomy")[x], 6).alias(f"crop_{x}") for x in ("x1", "y1", "x2", "y2")))


@query(f"{BASE} SELECT photo_id, candidate_idx, sx1 AS crop_x1, sy1 AS crop_y1, trunc(greatest(sx1 + 1, least(a_cx + a_w / 2, w))) AS crop_x2, trunc(greatest(sy1 + 1, least(a_bottom, h))) AS crop_y2 FROM f")
def smart_crop(spark, sf_dir):
    return G.with_smart_crop(_dets(spark, sf_dir), SETTINGS, "crop").select(*KEY, *_box("crop"))


@query(f"{BASE} SELECT photo_id, candidate_idx, round(off_x, 9) AS off_x, round(off_y, 9) AS off_y, round(greatest(off_x, off_y), 9) AS off_max FROM f")
def centre_offsets(spark, sf_dir):
    o = F.col("offsets")
    rows = D.prepared(_dets(spark, sf_dir), SETTINGS)
    return rows.select(*KEY, F.round(o["x"], 9).alias("off_x"), F.round(o["y"], 9).alias("off_y"), F.round(o["max"], 9).alias("off_max"))


_ISOLATION = f"{BASE} SELECT photo_id, candidate_idx, round(of_crop, 9) AS of_crop, round(of_other, 9) AS of_other FROM f"


@query(_ISOLATION)
def isolation(spark, sf_dir):
    alone = F.col("alone")
    return D.prepared(_dets(spark, sf_dir), SETTINGS).select(*KEY, F.round(alone["of_crop"], 9).alias("of_crop"), F.round(alone["of_other"], 9).alias("of_other"))


@query(_ISOLATION)
def isolation_join(spark, sf_dir):
    """The same by a self-join on the photo: the form to check the arrays by."""
    rows = D.prepared(_dets(spark, sf_dir), SETTINGS).select(*KEY, "crop")
    other = _dets(spark, sf_dir).select("photo_id", F.col("candidate_idx").alias("j"), "x1", "y1", "x2", "y2")
    c = F.col("crop")
    pairs = rows.join(other, "photo_id", "left")
    wide, tall = F.least(c["x2"], F.col("x2")) - F.greatest(c["x1"], F.col("x1")), F.least(c["y2"], F.col("y2")) - F.greatest(c["y1"], F.col("y1"))
    inter = F.when((F.col("j") != F.col("candidate_idx")) & (wide > 0) & (tall > 0), wide * tall).otherwise(0.0)
    of_crop = inter / F.greatest(F.lit(1.0), (c["x2"] - c["x1"]) * (c["y2"] - c["y1"]))
    of_other = inter / F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return pairs.groupBy(*KEY).agg(F.round(F.max(of_crop), 9).alias("of_crop"), F.round(F.max(of_other), 9).alias("of_other"))


_PARTS = ("sharpness", "center", "size", "keypoints", "isolation", "confidence", "fence_free")


@query(f"{BASE} SELECT photo_id, candidate_idx, {', '.join(f'round(p_{x}, 9) AS q_{x}' for x in _PARTS)} FROM f")
def score_components(spark, sf_dir):
    rows = D.scored(D.prepared(_dets(spark, sf_dir), SETTINGS), SETTINGS)
    return rows.select(*KEY, *(F.round(f"part_{x}", 9).alias(f"q_{x}") for x in _PARTS))


@query(f"{BASE} SELECT photo_id, candidate_idx, score, ceiling, class1 AS quality_class FROM f")
def quality_score(spark, sf_dir):
    rows = D.scored(D.prepared(_dets(spark, sf_dir), SETTINGS), SETTINGS, lean=True)
    return rows.select(*KEY, "score", "ceiling", S.quality_class(SETTINGS, F.col("score")).alias("quality_class"))


_DECISION = ("decision", "reason", "quality_class", "demoted_reason")
_ROWS = f"SELECT photo_id, candidate_idx, {', '.join(_DECISION)} FROM decided"


@query(f"{decided(fast=False)} {_ROWS}")
def decisions_slow(spark, sf_dir):
    return D.decide(_dets(spark, sf_dir), SLOW, lean=True).select(*KEY, *_DECISION)


@query(f"{decided()} {_ROWS}")
def decisions_fast(spark, sf_dir):
    return D.decide(_dets(spark, sf_dir), SETTINGS, lean=True).select(*KEY, *_DECISION)


@query(f"{decided(premium_only=True)} {_ROWS}")
def decisions_premium_only(spark, sf_dir):
    return D.decide(_dets(spark, sf_dir), PREMIUM, lean=True).select(*KEY, *_DECISION)


@query(f"{decided(save_review=True)} {_ROWS}")
def decisions_save_review(spark, sf_dir):
    return D.decide(_dets(spark, sf_dir), REVIEW, lean=True).select(*KEY, *_DECISION)


@query(f"{BASE} SELECT photo_id, candidate_idx FROM f WHERE gate IS NULL AND sharpness >= 80 AND (full_frame OR whole) AND ceiling >= 60")
def fence_candidates(spark, sf_dir):
    """Candidates that still need a fence measurement: the filter that stands before that stage."""
    rows = D.scored(D.prepared(_dets(spark, sf_dir), SETTINGS), SETTINGS, lean=True)
    return rows.filter(D.needs_fence(SETTINGS)).select(*KEY)


@query(f"{decided()} SELECT decision, reason, quality_class, count(*) AS n FROM decided GROUP BY ALL")
def counters(spark, sf_dir):
    return D.counters(D.decide(_dets(spark, sf_dir), SETTINGS, lean=True))


@query(
    f"{decided()}, a AS MATERIALIZED (SELECT photo_id, bool_or(decision = 'accept') AS accepted FROM decided GROUP BY 1), "
    "p AS (SELECT o_orderkey AS photo_id, CAST(o_orderkey % 200 AS DOUBLE) AS photo_sharpness, o_orderkey % 7 = 0 AS photo_fence FROM orders GROUP BY 1), "
    "r AS (SELECT p.*, CASE WHEN accepted IS NULL THEN 'no_person' ELSE 'no_accepted_candidates' END AS after FROM p LEFT JOIN a USING (photo_id) WHERE NOT coalesce(accepted, false)) "
    "SELECT photo_id, after, CASE WHEN photo_sharpness < 95 OR photo_fence THEN 'reject' ELSE 'accept' END AS decision, "
    "CASE WHEN photo_sharpness < 95 THEN 'fallback_too_soft_after_' WHEN photo_fence THEN 'fallback_fence_after_' ELSE 'fallback_after_' END || after AS reason, 50.0::DOUBLE AS score FROM r"
)
def fallback(spark, sf_dir):
    photos = fixture.photos(spark, sf_dir).withColumns({"photo_sharpness": (F.col("photo_id") % 200).cast("double"), "photo_fence": F.col("photo_id") % 7 == 0})
    return D.fallback(photos, D.decide(_dets(spark, sf_dir), FALLBACK, lean=True), FALLBACK)


@query(
    f"{decided()} SELECT photo_id, candidate_idx, CASE quality_class WHEN 'premium' THEN 'A_Premium' WHEN 'good' THEN 'B_Good' ELSE 'C_Review' END || '/' || photo_id || '_runner' || lpad(candidate_idx::VARCHAR, 2, '0') "
    "|| '_q' || round_even(score, 0)::INT || '_s' || sharpness::INT || '_c' || round_even(conf * 100, 0)::INT || '.jpg' AS output_name FROM decided WHERE decision = 'accept'"
)
def manifest_names(spark, sf_dir):
    rows = D.decide(_dets(spark, sf_dir), SETTINGS, lean=True)
    return rows.filter("decision = 'accept'").select(*KEY, "output_name")


@query(
    f"{decided(save_review=True)} SELECT photo_id, candidate_idx, quality_class, CASE WHEN quality_class = 'review' THEN CASE WHEN sharpness <= 160 THEN 'soft_focus' WHEN brightness < 60 THEN 'underexposed' WHEN brightness > 195 THEN 'overexposed' END END AS enhancement_reason, "
    "CASE quality_class WHEN 'review' THEN 'none' ELSE 'upscale' END AS enhance_mode FROM decided WHERE decision = 'accept'"
)
def enhancement(spark, sf_dir):
    rows = D.decide(_dets(spark, sf_dir), REVIEW, lean=True).filter("decision = 'accept'")
    return rows.select(*KEY, "quality_class", "enhancement_reason", "enhance_mode")


@query(
    f"{BASE}, z AS (SELECT *, c_x2 - c_x1 AS cw, c_y2 - c_y1 AS ch FROM f), y AS (SELECT *, CASE WHEN cw / ch > 0.666::DOUBLE THEN greatest(1, round_even(ch * 0.666::DOUBLE, 0)) ELSE cw END AS kw, "
    "CASE WHEN cw / ch > 0.666::DOUBLE THEN ch ELSE least(ch, greatest(1, round_even(cw / 0.666::DOUBLE, 0))) END AS kh FROM z) "
    'SELECT photo_id, candidate_idx, floor((cw - kw) / 2) AS "left", round_even((ch - kh) * 0.25::DOUBLE, 0) AS top, kw AS width, kh AS height, 2664::INT AS out_width, 4000::INT AS out_height FROM y'
)
def final_size(spark, sf_dir):
    rows = D.prepared(_dets(spark, sf_dir), SETTINGS)
    return rows.select(*KEY, G.final_size(SETTINGS, F.col("crop")).alias("f")).select(*KEY, "f.*")


@query(
    f"{BASE}, t AS (SELECT *, list_filter([1, 2, 3, 6, 7, 12, 13], lambda i: v[i]) AS u FROM f), b AS (SELECT *, list_min(list_transform(u, lambda i: kx[i])) AS lx, list_max(list_transform(u, lambda i: kx[i])) AS hx, "
    "list_min(list_transform(u, lambda i: ky[i])) AS ly, list_max(list_transform(u, lambda i: ky[i])) AS hy FROM t), p AS (SELECT *, greatest((hx - lx) * 0.05::DOUBLE, (y2 - y1) * 0.02::DOUBLE) AS px, greatest((hy - ly) * 0.08::DOUBLE, (y2 - y1) * 0.02::DOUBLE) AS py FROM b) "
    "SELECT photo_id, candidate_idx, round(CASE WHEN len(u) >= 3 THEN lx - px ELSE x1 END, 6) AS crop_x1, round(CASE WHEN len(u) >= 3 THEN ly - py ELSE y1 END, 6) AS crop_y1, "
    "round(CASE WHEN len(u) >= 3 THEN hx + px ELSE x2 END, 6) AS crop_x2, round(CASE WHEN len(u) >= 3 THEN hy + py ELSE y1 + (y2 - y1) * 0.65::DOUBLE END, 6) AS crop_y2 FROM p"
)
def subject_region(spark, sf_dir):
    rows = _dets(spark, sf_dir).withColumn("crop", G.subject_region(SETTINGS))
    return rows.select(*KEY, *(F.round(F.col("crop")[x], 6).alias(f"crop_{x}") for x in ("x1", "y1", "x2", "y2")))


@query(
    f"{BASE} SELECT photo_id, candidate_idx, (k % 9 >= 5 AND (k % 31 / 100.0::DOUBLE >= 0.13 OR k % 37 / 100.0::DOUBLE >= 0.22 OR k % 23 / 100.0::DOUBLE >= 0.15)) AS detected, "
    "round(greatest(k % 31 / 100.0::DOUBLE, k % 37 / 100.0::DOUBLE, k % 23 / 100.0::DOUBLE * 1.3::DOUBLE), 9) AS score FROM f"
)
def fence_decision(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS candidate_idx"
    rows = lines.selectExpr("l_orderkey AS photo_id", key, "l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber * 101 AS k")
    k = F.col("k")
    decision = S.fence_decision(SETTINGS, k % 9, k % 31 / 100.0, k % 37 / 100.0, k % 23 / 100.0)
    return rows.select(*KEY, decision.alias("f")).select(*KEY, F.col("f.detected").alias("detected"), F.round("f.score", 9).alias("score"))


@query(f"{decided()} SELECT photo_id, candidate_idx, regexp_replace(coalesce(demoted_reason, reason || '!'), '[^\\p{{L}}\\p{{N}}._-]', '_', 'g')[:60] AS reject_name FROM decided WHERE decision = 'reject'")
def reject_names(spark, sf_dir):
    rows = D.decide(_dets(spark, sf_dir), SETTINGS, lean=True).filter("decision = 'reject'")
    return rows.select(*KEY, D.reject_name(F.coalesce("demoted_reason", F.concat("reason", F.lit("!")))).alias("reject_name"))


STRICT = config.merged({"completeness_guard": {"review_on_partial": False}, "performance": {"fast_path": False}})


@query(
    f"{BASE} SELECT photo_id, candidate_idx, CASE WHEN reason = 'ok' THEN 'accept' ELSE 'reject' END AS decision, reason, CASE WHEN gate IS NULL AND sharpness >= 80 AND NOT fence_detected THEN class2 END AS quality_class, "
    "CASE WHEN gate IS NULL AND sharpness >= 80 AND NOT fence_detected AND class2 <> class1 THEN 'soft_for_premium' END AS demoted_reason FROM (SELECT *, "
    "CASE WHEN gate IS NOT NULL THEN gate WHEN sharpness < 80 THEN 'blurred' WHEN fence_detected THEN 'fence_detected' WHEN NOT full_frame AND NOT whole THEN part_reason WHEN class2 NOT IN ('premium', 'good') THEN 'low_quality_score' ELSE 'ok' END AS reason FROM f)"
)
def decisions_strict_guard(spark, sf_dir):
    """Partial persons are rejected instead of going to Review."""
    return D.decide(_dets(spark, sf_dir), STRICT, lean=True).select(*KEY, *_DECISION)


@query(
    f"{decided()}, c AS (SELECT count(DISTINCT photo_id) AS images_with_person, count_if(decision = 'accept') AS processed_crops, count_if(decision = 'accept' AND quality_class = 'premium') AS quality_premium, "
    "count_if(decision = 'accept' AND quality_class = 'good') AS quality_good, count_if(decision = 'accept' AND quality_class = 'review') AS quality_review, count_if(reason = 'too_small') AS too_small, "
    "count_if(reason = 'unsafe_edge') AS unsafe_edge, count_if(reason = 'too_few_keypoints') AS bad_pose, count_if(reason = 'blurred') AS blurred, count_if(reason = 'fence_detected') AS fence_rejected, "
    "count_if(reason = 'low_quality_score') AS low_quality_score, count_if(quality_class IS NOT NULL AND class1 = 'premium' AND class2 = 'good') AS demoted_soft, "
    "count_if(quality_class IS NOT NULL AND NOT full_frame AND NOT whole AND class2 IN ('premium', 'good')) AS demoted_partial FROM decided), p AS (SELECT count(DISTINCT o_orderkey) AS total_images FROM orders), "
    "r AS (SELECT *, total_images - images_with_person AS no_person, 0 AS pre_check_rejected, 0 AS fallback_saved, 0 AS crop_failed, 0 AS partial_body, 0 AS truncated_frame, 0 AS write_failed, 0 AS errors FROM c, p), "
    "u AS (UNPIVOT r ON COLUMNS(*) INTO NAME counter VALUE n) SELECT counter, n::BIGINT AS n FROM u"
)
def tally(spark, sf_dir):
    """The counters of a run by their names."""
    return D.tally(D.decide(_dets(spark, sf_dir), SETTINGS, lean=True), fixture.photos(spark, sf_dir))


@query(
    f"{decided(save_review=True)} SELECT photo_id, candidate_idx, quality_class <> 'review' AND c_y2 - c_y1 < 1200 AS upscaled, quality_class <> 'premium' AS post_processed FROM decided WHERE decision = 'accept'"
)
def post_processing(spark, sf_dir):
    return D.post_processing(D.decide(_dets(spark, sf_dir), REVIEW, lean=True), REVIEW).select(*KEY, "upscaled", "post_processed")


@query(
    f"{decided(save_review=True)}, review AS MATERIALIZED (SELECT photo_id, candidate_idx, CASE WHEN sharpness <= 160 THEN 'soft_focus' WHEN brightness < 60 THEN 'underexposed' WHEN brightness > 195 THEN 'overexposed' END AS enhancement_reason "
    "FROM decided WHERE decision = 'accept' AND quality_class = 'review') SELECT * FROM review WHERE enhancement_reason IS NOT NULL OR NOT EXISTS (SELECT 1 FROM review WHERE enhancement_reason IS NOT NULL)"
)
def second_pass(spark, sf_dir):
    review = D.decide(_dets(spark, sf_dir), REVIEW, lean=True).filter("quality_class = 'review'").select(*KEY, "decision", "quality_class", "enhancement_reason")
    return D.second_pass(settled(review)).select(*KEY, "enhancement_reason")


@query(
    f"{decided()} SELECT photo_id, candidate_idx, full_frame, decision, reason, sharpness, CASE WHEN quality_class IS NOT NULL THEN score END AS quality_score, quality_class, demoted_reason, completeness, upper_ok AS has_upper_body, cut_top AS truncated_top, "
    "round_even(y2 - y1, 1) AS box_height FROM decided"
)
def report(spark, sf_dir):
    rows = D.report(D.decide(fixture.detections(spark, sf_dir, in_order=True), SETTINGS, lean=True))
    return rows.select(*KEY, "full_frame", "decision", "reason", "sharpness", "quality_score", "quality_class", "demoted_reason", "completeness", "has_upper_body", "truncated_top", "box_height")


_GRID = "g AS (SELECT vec_id AS photo_id, i // 8 AS r, i % 8 AS c, floor((embedding[i + 1]::DOUBLE + 1) * 127.5) * 1.6 - 60 AS v FROM embeddings, range(64) t(i))"


def _grid(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("photo_id"), F.posexplode("embedding").alias("i", "e"))
    return e.selectExpr("photo_id", "CAST(i DIV 8 AS INT) AS r", "i % 8 AS c", "floor((CAST(e AS DOUBLE) + 1) * 127.5D) * 1.6D - 60 AS v")


_LAP = (
    f"WITH {_GRID}, n AS (SELECT *, lag(v) OVER a AS le, lead(v) OVER a AS ri, lag(v) OVER d AS up, lead(v) OVER d AS lo FROM g WINDOW a AS (PARTITION BY photo_id, r ORDER BY c), d AS (PARTITION BY photo_id, c ORDER BY r)), "
    "m AS (SELECT photo_id, round(var_pop(coalesce(le, ri) + coalesce(ri, le) + coalesce(up, lo) + coalesce(lo, up) - 4 * v), 6) AS sharpness, round(avg(v), 6) AS brightness FROM n GROUP BY 1)"
)


@query(f"{_LAP} SELECT photo_id, sharpness FROM m")
def pixel_sharpness(spark, sf_dir):
    return P.laplacian_variance(_grid(spark, sf_dir))


@query(f"{_LAP} SELECT photo_id, brightness FROM m")
def pixel_brightness(spark, sf_dir):
    return P.brightness(_grid(spark, sf_dir))


@query(f"{_LAP} SELECT photo_id, sharpness >= 50 AND brightness BETWEEN 30 AND 230 AS passes FROM m")
def pre_check(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return P.pre_check(P.laplacian_variance(grid).join(P.brightness(grid), "photo_id"), SETTINGS).select("photo_id", "passes")


@query(
    f"WITH {_GRID}, b AS (SELECT photo_id, r, c, (v > 130)::INT AS x FROM g), e1 AS (SELECT photo_id, r, c, (SELECT min(x) FROM b q WHERE q.photo_id = b.photo_id AND abs(q.r - b.r) <= 1 AND abs(q.c - b.c) <= 1) AS x FROM b) "
    'SELECT photo_id, r::INT AS r, c::INT AS c, (SELECT max(x) FROM e1 q WHERE q.photo_id = e1.photo_id AND abs(q.r - e1.r) <= 1 AND abs(q.c - e1.c) <= 1) AS "on" FROM e1'
)
def pixel_opening(spark, sf_dir):
    return P.vertical_opening(_grid(spark, sf_dir), 1, 1, 130)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def extension_event_rates(spark, sf_dir):
    """Extension: the windowed rates of the streaming module, over the table."""
    return ingest.rates(spark.read.parquet(f"{sf_dir}/events.parquet"))
