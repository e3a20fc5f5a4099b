"""Registered queries of the pixel stages, the staged plan, the detector's seam and the sinks, each with DuckDB text for the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import config
from sightline.functions import geometry as G
from sightline.operators import decide as D
from sightline.operators import enhance, fences, report, sinks, staged, suppress
from sightline.operators.tables import settled, shared_folder
from sightline.plans.core_queries import FALLBACK, KEY, ORACLES, QUERIES, SETTINGS, _dets, query
from sightline.plans.oracle_base import BASE, decided
from sightline.sources import fixture
from sightline.sources import photos as photo_files

__all__ = ["ORACLES", "QUERIES"]

# ---- pictures: 64 x 64, made of a vector's components; columns are mostly alike, so they hold vertical lines

SIDE = 64
FENCE = config.merged({"fence_detection": {"bright_threshold": 160, "reject_vertical_line_count": 2, "reject_person_occlusion_coverage": 0.2, "reject_central_occlusion_score": 0.2}})
_PICTURES = (
    "pic AS (SELECT vec_id AS photo_id, r::INT AS r, c::INT AS c, floor((embedding[c // 3 + 1]::DOUBLE + 1) * 127.5) * 1.6 - 60 + floor(embedding[r // 4 + 33]::DOUBLE * 100) AS v "
    "FROM embeddings, range(64) a(r), range(64) b(c))"
)
_OPENED = (
    f"{_PICTURES}, b0 AS (SELECT photo_id, r, c, (v > 160)::INT AS x FROM pic), b1 AS (SELECT *, min(x) OVER (PARTITION BY photo_id, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x1 FROM b0), "
    "b2 AS (SELECT *, min(x1) OVER (PARTITION BY photo_id, c ORDER BY r ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS x2 FROM b1), "
    "b3 AS (SELECT *, max(x2) OVER (PARTITION BY photo_id, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x3 FROM b2), "
    "b4 AS (SELECT photo_id, r, c FROM (SELECT *, max(x3) OVER (PARTITION BY photo_id, c ORDER BY r ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING) AS x4 FROM b3) WHERE x4 = 1), "
    "u0 AS (SELECT *, c - row_number() OVER (PARTITION BY photo_id, r ORDER BY c) AS g FROM b4), u AS MATERIALIZED (SELECT photo_id, r, min(c) AS a, max(c) AS z, r * 64 + min(c) AS id FROM u0 GROUP BY photo_id, r, g), "
    "e0 AS (SELECT p.photo_id, p.id AS i, q.id AS j FROM u p JOIN u q ON p.photo_id = q.photo_id AND q.r = p.r + 1 AND q.a <= p.z + 1 AND p.a <= q.z + 1), e AS MATERIALIZED (SELECT * FROM e0 UNION ALL SELECT photo_id, j, i FROM e0), "
    "fl AS (SELECT photo_id, id AS top, id FROM u WHERE NOT EXISTS (SELECT 1 FROM e0 WHERE e0.photo_id = u.photo_id AND e0.j = u.id) UNION SELECT fl.photo_id, fl.top, e.j FROM fl JOIN e ON e.photo_id = fl.photo_id AND e.i = fl.id), "
    "lb AS (SELECT photo_id, id, min(top) AS label FROM fl GROUP BY ALL), ul AS MATERIALIZED (SELECT u.*, label FROM u JOIN lb USING (photo_id, id)), "
    "ar AS MATERIALIZED (SELECT photo_id, label, min(r) AS r0, max(r) AS r1, min(a) AS c0, max(z) AS c1, sum(z - a + 1)::BIGINT AS pixels FROM ul GROUP BY ALL), "
    "ln AS MATERIALIZED (SELECT ul.* FROM ul JOIN ar USING (photo_id, label) WHERE r1 - r0 + 1 >= 64 * 0.32 AND c1 - c0 + 1 <= 64 * 0.11 AND (r1 - r0 + 1) / (c1 - c0 + 1) >= 3)"
)


def _figures(persons: str) -> str:
    """CTEs with the fence figures of rows of ``persons``: photo_id, candidate_idx, px1, py1, px2, py2."""
    return (
        "wh AS (SELECT photo_id, count(DISTINCT label)::INT AS lines, sum(z - a + 1) / 4096.0::DOUBLE AS coverage, sum(greatest(0, least(z + 1, 50) - greatest(a, 13))) / (64 * 37.0::DOUBLE) AS central FROM ln GROUP BY 1), "
        f"mt AS (SELECT p.photo_id, p.candidate_idx, sum(greatest(0, least(z + 1, px2) - greatest(a, px1))) AS met FROM {persons} p JOIN ln ON ln.photo_id = p.photo_id AND r >= py1 AND r < py2 GROUP BY ALL), "
        f"fg0 AS (SELECT p.photo_id, p.candidate_idx, coalesce(lines, 0) AS lines, coalesce(met / greatest(1.0, (px2 - px1) * (py2 - py1))::DOUBLE, 0.0) AS person, coalesce(central, 0.0) AS central, coalesce(coverage, 0.0) AS coverage FROM {persons} p LEFT JOIN wh USING (photo_id) LEFT JOIN mt ON mt.photo_id = p.photo_id AND mt.candidate_idx = p.candidate_idx), "
        "fg AS MATERIALIZED (SELECT *, greatest(person, central, coverage * 1.3::DOUBLE) AS fence_score, lines >= 2 AND (person >= 0.2 OR central >= 0.2 OR coverage >= 0.15) AS fence_detected FROM fg0)"
    )


#: Vectors that are dealt to one task: as pictures of 64 x 64 they are two million rows, which are sorted without spilling.
DEALT = 500


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors dealt by photo before they become pixels: what groups by photo later needs no shuffle, and a shuffle moves a row per picture instead of one per pixel."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS photo_id", "embedding")
    return e.repartition(max(spark.sparkContext.defaultParallelism, -(-e.count() // DEALT)), "photo_id")


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).selectExpr("photo_id", "embedding", f"explode(sequence(0, {SIDE - 1})) AS r").selectExpr("*", f"explode(sequence(0, {SIDE - 1})) AS c")
    v = "floor((double(get(embedding, c div 3)) + 1) * 127.5D) * 1.6D - 60 + floor(double(get(embedding, r div 4 + 32)) * 100D) AS v"
    return rows.selectExpr("photo_id", f"{SIDE} AS h", f"{SIDE} AS w", "r", "c", v)


@query(f"WITH RECURSIVE {_OPENED} SELECT photo_id, r0, r1, c0, c1, pixels FROM ar")
def fence_areas(spark, sf_dir):
    """8-connected areas of the bright vertical strokes of each picture."""
    runs = fences.labelled(fences.opened_runs(_pictures(spark, sf_dir), FENCE))
    return fences.areas(runs).select("photo_id", "r0", "r1", "c0", "c1", "pixels")


_PERSONS = "pe AS (SELECT vec_id AS photo_id, vec_id % 3 AS candidate_idx, 8 + vec_id % 7 AS px1, 4 AS py1, 40 + vec_id % 17 AS px2, 60 AS py2 FROM embeddings)"


@query(f"WITH RECURSIVE {_OPENED}, {_PERSONS}, {_figures('pe')} SELECT photo_id, lines, round(person, 9) AS person, round(central, 9) AS central, round(coverage, 9) AS coverage, round(fence_score, 9) AS fence_score, fence_detected FROM fg")
def fence_figures(spark, sf_dir):
    """Fence figures and the decision, from pixels."""
    persons = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS photo_id", "vec_id % 3 AS candidate_idx", "8 + vec_id % 7 AS px1", "4 AS py1", "40 + vec_id % 17 AS px2", "60 AS py2")
    out = fences.figures(_pictures(spark, sf_dir), persons, FENCE)
    return out.select("photo_id", "lines", *(F.round(x, 9).alias(x) for x in ("person", "central", "coverage", "fence_score")), "fence_detected")


# ---- the staged plan: a candidate's crop is seen in the picture of vector (photo_id + candidate_idx) mod 500


def _seen_boxes(rows: DataFrame) -> DataFrame:
    """Each candidate's picture and its box there, in whole pixels."""
    c = F.col("crop")
    at = {"px1": ("x1", "x1", "x2"), "py1": ("y1", "y1", "y2"), "px2": ("x2", "x1", "x2"), "py2": ("y2", "y1", "y2")}
    place = {n: F.floor(G.clamp((F.col(box) - c[low]) / F.greatest(F.lit(1.0), c[high] - c[low]), G.num(0), G.num(1)) * SIDE).cast("int") for n, (box, low, high) in at.items()}
    return rows.select("photo_id", "candidate_idx", ((F.col("photo_id") + F.col("candidate_idx")) % 500).alias("picture"), *(v.alias(n) for n, v in place.items()))


def _fences_of(spark: SparkSession, sf_dir: str, s: dict):
    def fence_stage(rows: DataFrame) -> DataFrame:
        persons = _seen_boxes(rows).select(F.col("picture").alias("photo_id"), F.struct("photo_id", "candidate_idx").alias("candidate_idx"), "px1", "py1", "px2", "py2")
        wanted = _pictures(spark, sf_dir).join(persons.select("photo_id").distinct(), "photo_id", "left_semi")
        return fences.figures(wanted, persons, s).select("candidate_idx.photo_id", "candidate_idx.candidate_idx", "fence_score", "fence_detected")

    return fence_stage


def _staged_sql() -> str:
    place = "floor(greatest(0.0, least(({box} - {low}) / greatest(1.0, {high} - {low}), 1.0)) * 64)::INT AS {name}"
    boxes = ", ".join(place.format(box=b, low=lo, high=hi, name=n) for n, b, lo, hi in (("px1", "x1", "c_x1", "c_x2"), ("py1", "y1", "c_y1", "c_y2"), ("px2", "x2", "c_x1", "c_x2"), ("py2", "y2", "c_y1", "c_y2")))
    seen = f"pe AS MATERIALIZED (SELECT (photo_id + candidate_idx) % 500 AS photo_id, {{'p': photo_id, 'i': candidate_idx}} AS candidate_idx, {boxes} FROM d12)"
    whole = decided().replace("WITH d0 AS", f"WITH RECURSIVE {_OPENED}, d0 AS", 1)
    # the fixture's fence figures give way to those of the pixels
    whole = whole.replace("d13 AS (\n  SELECT d12.*,", f"{seen}, {_figures('pe')},\nd13 AS (\n  SELECT d12.* EXCLUDE (fence_score, fence_detected), fg.fence_score, fg.fence_detected,", 1)
    return whole.replace("FROM d12 LEFT JOIN iso USING (photo_id, candidate_idx))", "FROM d12 LEFT JOIN iso USING (photo_id, candidate_idx) LEFT JOIN fg ON fg.candidate_idx.p = d12.photo_id AND fg.candidate_idx.i = d12.candidate_idx)", 1)


STAGED = config.merged({"fence_detection": FENCE["fence_detection"]})


@query(f"{_staged_sql()} SELECT photo_id, candidate_idx, decision, reason, quality_class, demoted_reason FROM decided")
def decisions_staged(spark, sf_dir):
    """Decisions with fences measured from pixels, for those candidates only that a fence can still change."""
    out = staged.decide_staged(_dets(spark, sf_dir), STAGED, _fences_of(spark, sf_dir, STAGED), lean=True)
    return out.select(*KEY, "decision", "reason", "quality_class", "demoted_reason")


# ---- the detector's seam

NMS = config.merged({"detector": {"iou": 0.2, "max_det": 4}, "selection_filters": {"conf_threshold": 0.4}})


@query(
    f"{BASE.replace('WITH d0', 'WITH RECURSIVE d0', 1)}, ra AS MATERIALIZED (SELECT photo_id, candidate_idx, conf, x1, y1, x2, y2, row_number() OVER (PARTITION BY photo_id ORDER BY conf DESC, candidate_idx) AS k FROM d3 WHERE conf >= 0.4), "
    "st AS (SELECT photo_id, 0 AS k, []::STRUCT(i INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM (SELECT DISTINCT photo_id FROM ra) UNION ALL "
    "SELECT st.photo_id, ra.k, CASE WHEN len(kept) >= 4 OR len(list_filter(kept, lambda o: greatest(0, least(o.x2, ra.x2) - greatest(o.x1, ra.x1)) * greatest(0, least(o.y2, ra.y2) - greatest(o.y1, ra.y1)) / "
    "((o.x2 - o.x1) * (o.y2 - o.y1) + (ra.x2 - ra.x1) * (ra.y2 - ra.y1) - greatest(0, least(o.x2, ra.x2) - greatest(o.x1, ra.x1)) * greatest(0, least(o.y2, ra.y2) - greatest(o.y1, ra.y1))) > 0.2)) > 0 THEN kept "
    "ELSE list_append(kept, {'i': ra.candidate_idx, 'x1': ra.x1, 'y1': ra.y1, 'x2': ra.x2, 'y2': ra.y2}) END FROM st JOIN ra ON ra.photo_id = st.photo_id AND ra.k = st.k + 1), "
    "la AS (SELECT photo_id, arg_max(kept, k) AS kept FROM st GROUP BY 1) SELECT photo_id, t.place - 1 AS place, kept[t.place].i AS candidate_idx FROM la, unnest(range(1, len(kept) + 1)) AS t(place)"
)
def suppression(spark, sf_dir):
    """Which raw detections stay, surest first."""
    kind = "array<struct<i:int,conf:double,box:struct<x1:double,y1:double,x2:double,y2:double>>>"
    one = F.struct(F.col("candidate_idx").alias("i"), "conf", F.struct("x1", "y1", "x2", "y2").alias("box"))
    photos = _dets(spark, sf_dir).groupBy("photo_id").agg(F.array_sort(F.collect_list(one)).alias("dets"))
    kept = photos.select("photo_id", F.posexplode(suppress.suppressed(F.col("dets"), NMS, kind)).alias("place", "d"))
    return kept.select("photo_id", F.col("place").cast("long").alias("place"), F.col("d.i").alias("candidate_idx"))


def _stub_model(batches):
    """Finds a person in each photo of an even key; can't stand keys that end in 77, nor any batch with one."""
    for pdf in batches:
        keys = pdf.photo_id.to_numpy()
        if len(lost := keys[keys % 100 == 77]):
            raise RuntimeError(f"photo {lost[0]}")
        box = lambda k: {"x1": float(k % 50), "y1": 0.0, "x2": float(k % 50 + 100), "y2": 300.0}
        yield pd.DataFrame({"photo_id": keys, "dets": [[{"box": box(k), "conf": 0.9, "kps": None}] if k % 2 == 0 else [] for k in keys.tolist()]})


@query("SELECT DISTINCT o_orderkey AS photo_id, CASE WHEN o_orderkey % 100 = 77 THEN 'batch_predict_exception: photo ' || o_orderkey END AS error, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_found FROM orders")
def batch_isolation(spark, sf_dir):
    """A model that fails on some photos: these alone are errors, whatever batch they came in."""
    found = photo_files.detect(fixture.photos(spark, sf_dir).select("photo_id"), _stub_model, SETTINGS)
    return found.select("photo_id", "error", F.size("dets").alias("n_found"))


# ---- pixels: resampling, contrast, denoising, on the vectors as 8 x 8 pictures of whole levels

_SMALL = "sm AS (SELECT vec_id AS photo_id, (i // 8)::INT AS r, (i % 8)::INT AS c, floor((embedding[i + 1]::DOUBLE + 1) * 127.5)::DOUBLE AS v FROM embeddings, range(64) t(i))"


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).select("photo_id", F.posexplode("embedding").alias("i", "e"))
    return e.selectExpr("photo_id", "8 AS h", "8 AS w", "i div 8 AS r", "i % 8 AS c", "double(floor((double(e) + 1) * 127.5D)) AS v").withColumns({"r": F.col("r").cast("int"), "c": F.col("c").cast("int")})


@query(
    f"WITH {_SMALL}, wt AS (SELECT m, o, i, greatest(0.0, least((o + 1) * 8.0::DOUBLE / m, i + 1) - greatest(o * 8.0::DOUBLE / m, i)) / (8.0::DOUBLE / m) AS x FROM (VALUES (5), (3)) t(m), range(5) a(o), range(8) b(i) WHERE o < m) "
    "SELECT photo_id, p.o::INT AS r, q.o::INT AS c, round(sum(v * p.x * q.x), 9) AS v FROM sm JOIN wt p ON p.m = 5 AND p.i = r JOIN wt q ON q.m = 3 AND q.i = c GROUP BY photo_id, p.o, q.o"
)
def resampled_smaller(spark, sf_dir):
    return enhance.resampled(_small(spark, sf_dir), 5, 3).select("photo_id", "r", "c", F.round("v", 9).alias("v"))


@query(
    f"WITH {_SMALL}, tp AS (SELECT m, o, (o + 0.5::DOUBLE) * 8 / m - 0.5::DOUBLE AS x, t FROM (VALUES (20), (13)) s(m), range(20) a(o), range(-4, 12) b(t) WHERE o < m), "
    "ra AS (SELECT m, o, greatest(0, least(7, t)) AS i, CASE WHEN abs(x - t) >= 4 THEN 0 WHEN x = t THEN 1 ELSE sin(pi() * (x - t)) / (pi() * (x - t)) * sin(pi() * (x - t) / 4) / (pi() * (x - t) / 4) END AS k FROM tp), "
    "wt AS (SELECT m, o, i, sum(k) / any_value(total) AS x FROM ra JOIN (SELECT m, o, sum(k) AS total FROM ra GROUP BY ALL) USING (m, o) GROUP BY ALL) "
    "SELECT photo_id, p.o::INT AS r, q.o::INT AS c, round(sum(v * p.x * q.x), 7) AS v FROM sm JOIN wt p ON p.m = 20 AND p.i = r JOIN wt q ON q.m = 13 AND q.i = c GROUP BY photo_id, p.o, q.o"
)
def resampled_larger(spark, sf_dir):
    return enhance.resampled(_small(spark, sf_dir), 20, 13).select("photo_id", "r", "c", F.round("v", 7).alias("v"))


@query(
    f"WITH {_PICTURES}, px AS (SELECT photo_id, r, c, greatest(0, least(255, round_even(v, 0)))::INT AS v FROM pic), hi AS (SELECT photo_id, r // 16 AS ty, c // 16 AS tx, v, count(*) AS n FROM px GROUP BY ALL), "
    "ov AS (SELECT photo_id, ty, tx, sum(greatest(n - 4, 0))::BIGINT AS o FROM hi GROUP BY ALL), "
    "de AS (SELECT ov.photo_id, ov.ty, ov.tx, l.v, least(coalesce(n, 0), 4) + o // 256 + CASE WHEN o % 256 > 0 AND l.v % greatest(256 // greatest(o % 256, 1), 1) = 0 AND l.v // greatest(256 // greatest(o % 256, 1), 1) < o % 256 THEN 1 ELSE 0 END AS n "
    "FROM ov CROSS JOIN range(256) l(v) LEFT JOIN hi ON hi.photo_id = ov.photo_id AND hi.ty = ov.ty AND hi.tx = ov.tx AND hi.v = l.v), "
    "lu AS (SELECT photo_id, ty, tx, v, least(255, round_even((sum(n) OVER (PARTITION BY photo_id, ty, tx ORDER BY v))::DOUBLE * (255.0::DOUBLE / 256), 0)) AS y FROM de), "
    "pl AS (SELECT *, floor(r / 16.0::DOUBLE - 0.5)::INT AS y1, r / 16.0::DOUBLE - 0.5 - floor(r / 16.0::DOUBLE - 0.5) AS fy, floor(c / 16.0::DOUBLE - 0.5)::INT AS x1, c / 16.0::DOUBLE - 0.5 - floor(c / 16.0::DOUBLE - 0.5) AS fx FROM px) "
    "SELECT photo_id, r, sum(v)::DOUBLE AS total, sum(v * (c + 1))::DOUBLE AS moment FROM (SELECT p.photo_id, p.r, p.c, round_even((a.y * (1 - fx) + b.y * fx) * (1 - fy) + (d.y * (1 - fx) + e.y * fx) * fy, 0) AS v FROM pl p "
    "JOIN lu a ON a.photo_id = p.photo_id AND a.v = p.v AND a.ty = greatest(0, y1) AND a.tx = greatest(0, x1) JOIN lu b ON b.photo_id = p.photo_id AND b.v = p.v AND b.ty = greatest(0, y1) AND b.tx = least(3, x1 + 1) "
    "JOIN lu d ON d.photo_id = p.photo_id AND d.v = p.v AND d.ty = least(3, y1 + 1) AND d.tx = greatest(0, x1) JOIN lu e ON e.photo_id = p.photo_id AND e.v = p.v AND e.ty = least(3, y1 + 1) AND e.tx = least(3, x1 + 1)) GROUP BY ALL"
)
def equalised(spark, sf_dir):
    """Local contrast, over 4 x 4 parts of 16 x 16 pixels: sum and first moment of each row of pixels."""
    pictures = _pictures(spark, sf_dir).withColumn("v", enhance.whole_level(F.col("v")))
    return enhance.equalised(pictures, clip=4.0, tiles=4).groupBy("photo_id", "r").agg(F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("c") + 1)).alias("moment"))


@query(
    "WITH p AS (SELECT vec_id AS photo_id, vec_id % 9 AS o, (i // 16)::INT AS r, (i % 16)::INT AS c, floor((embedding[i + 1]::DOUBLE + 1) * 127.5)::DOUBLE AS v FROM embeddings, range(64) t(i)), "
    "f AS (SELECT photo_id, v, o, CASE WHEN o IN (3, 4, 7, 8) THEN 3 - r ELSE r END AS r1, CASE WHEN o IN (2, 3, 7, 6) THEN 15 - c ELSE c END AS c1, r, c FROM p) "
    "SELECT photo_id, CASE WHEN o >= 5 THEN 16 ELSE 4 END AS h, CASE WHEN o >= 5 THEN 4 ELSE 16 END AS w, CASE WHEN o IN (7, 8) THEN 15 - c WHEN o IN (5, 6) THEN c ELSE r1 END AS r, "
    "CASE WHEN o IN (6, 7) THEN 3 - r WHEN o IN (5, 8) THEN r ELSE c1 END AS c, v FROM f"
)
def oriented(spark, sf_dir):
    """Pictures of 4 x 16 turned by orientations 0 to 8."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("photo_id"), F.posexplode("embedding").alias("i", "e"))
    pixels = e.selectExpr("photo_id", "photo_id % 9 AS orientation", "4 AS h", "16 AS w", "int(i div 16) AS r", "int(i % 16) AS c", "double(floor((double(e) + 1) * 127.5D)) AS v")
    return enhance.oriented(pixels)


def _mirror(i: str) -> str:
    return f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > 7 THEN 14 - ({i}) ELSE {i} END)"


@query(
    "WITH e AS (SELECT vec_id AS photo_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::DOUBLE) AS g FROM embeddings), "
    "p AS (SELECT photo_id, g, r, c, dy, dx FROM e, range(8) a(r), range(8) b(c), range(-2, 3) y(dy), range(-2, 3) x(dx)), "
    "s AS (SELECT photo_id, r, c, g[" + _mirror("r + dy") + " * 8 + " + _mirror("c + dx") + " + 1] AS v2, list_sum(list_transform(range(9), lambda t: pow(g[" + _mirror("r + t // 3 - 1") + " * 8 + " + _mirror("c + t % 3 - 1") + " + 1] - g["
    + _mirror("r + dy + t // 3 - 1") + " * 8 + " + _mirror("c + dx + t % 3 - 1") + " + 1], 2))) / 9 AS d FROM p), "
    "w AS (SELECT *, CASE WHEN exp(-d / 400) >= 0.001 THEN exp(-d / 400) ELSE 0 END AS x FROM s) SELECT photo_id, r::INT AS r, c::INT AS c, round(sum(x * v2) / sum(x), 6) AS v FROM w GROUP BY ALL"
)
def denoised(spark, sf_dir):
    """Non-local means with a template of 3 and a search window of 5."""
    return enhance.denoised(_small(spark, sf_dir), strength=20.0, template=3, search=5).select("photo_id", "r", "c", F.round("v", 6).alias("v"))


# ---- sinks


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as files; one in fifty has a name that no file system takes."""
    made = enhance.portable_graymap(_small(spark, sf_dir))
    k = F.col("photo_id") % 3
    folder = F.when(k == 0, "A_Premium").when(k == 1, "B_Good").otherwise("C_Review")
    name = F.when(F.col("photo_id") % 50 == 7, F.repeat(F.lit("x"), 300)).otherwise(F.format_string("photo%06d", "photo_id"))
    return made.select("photo_id", F.lit(0).alias("candidate_idx"), F.concat_ws("/", folder, F.concat(name, F.lit(".pgm"))).alias("output_name"), "content", F.lit("accept").alias("decision"), F.lit("ok").alias("reason"))


@query(
    f"WITH {_SMALL}, x AS (SELECT photo_id, string_agg(printf('%02x', v::INT), '' ORDER BY r, c) AS h FROM sm GROUP BY 1) "
    "SELECT photo_id, CASE WHEN photo_id % 50 = 7 THEN 'write_failed' ELSE 'ok' END AS reason, CASE WHEN photo_id % 50 <> 7 THEN 75::BIGINT END AS n_bytes, "
    "CASE WHEN photo_id % 50 <> 7 THEN md5(unhex('50350a3820380a3235350a' || h)) END AS content_md5 FROM x"
)
def written_crops(spark, sf_dir):
    """Files written by the sink and read back; those that couldn't be are rows with a reason."""
    rows, path = _crops(spark, sf_dir), shared_folder(spark, "crops")
    failed = sinks.write_crops(rows, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pgm").load(path)
    files = files.select(F.regexp_extract("path", r"photo(\d+)\.pgm$", 1).cast("long").alias("photo_id"), F.col("length").alias("n_bytes"), F.md5("content").alias("content_md5"))
    told = sinks.with_failures(rows.drop("content"), failed)
    return told.join(files, "photo_id", "left").select("photo_id", "reason", "n_bytes", "content_md5")


@query(
    "SELECT counter, n FROM (WITH c AS (SELECT count_if(vec_id % 50 = 7) AS f, count_if(vec_id % 50 <> 7) AS a FROM embeddings) SELECT 'write_failed' AS counter, f::BIGINT AS n FROM c UNION ALL SELECT 'processed_crops', a::BIGINT FROM c)"
)
def write_tally(spark, sf_dir):
    """The counters of written and lost crops, from real writes."""
    rows = _crops(spark, sf_dir)
    told = sinks.with_failures(rows.drop("content"), sinks.write_crops(rows, shared_folder(spark, "crops")))
    more = {"quality_class": F.lit(None).cast("string"), "class1": F.lit(None).cast("string"), "class2": F.lit(None).cast("string"), "demoted_reason": F.lit(None).cast("string"), "complete": F.struct(F.lit(False).alias("truncated_top"))}
    return D.tally(told.withColumns(more), rows.select("photo_id")).filter(F.col("counter").isin("write_failed", "processed_crops"))


# ---- the report as a file

_IN_REPORT = ("confidence", "sharpness", "quality_score", "quality_class", "completeness", "fence_score", "crop_x1")
_KINDS = ", ".join(f"('{kind}', {k}, '{name}')" for kind, names in report.KINDS.items() for k, name in enumerate(names))


@query(
    f"{decided()}, lost AS (SELECT DISTINCT o_orderkey AS photo_id FROM orders WHERE o_orderkey % 100 = 77), cd AS (SELECT * FROM decided WHERE photo_id % 100 <> 77), "
    "se AS (SELECT photo_id, bool_or(decision = 'accept') AS accepted FROM cd GROUP BY 1), "
    "wh AS (SELECT p.photo_id, CASE WHEN accepted IS NULL THEN 'no_person' ELSE 'no_accepted_candidates' END AS after, CAST(p.photo_id % 200 AS DOUBLE) AS sharp, p.photo_id % 7 = 0 AS fence FROM (SELECT DISTINCT o_orderkey AS photo_id FROM orders WHERE o_orderkey % 100 <> 77) p LEFT JOIN se USING (photo_id) WHERE NOT coalesce(accepted, false)), "
    "ro AS MATERIALIZED (SELECT photo_id, candidate_idx AS place, candidate_idx::VARCHAR AS candidate_idx, decision, reason, CASE WHEN decision = 'accept' THEN 'accepted' WHEN reason = 'too_few_keypoints' THEN 'pose' WHEN reason IN ('unsafe_edge', 'too_small') THEN 'gate' WHEN reason IN ('blurred', 'skipped_score') THEN 'soft' "
    "WHEN reason LIKE 'skipped\\_%' ESCAPE '\\' THEN 'early' WHEN reason = 'fence_detected' THEN 'fence' ELSE 'scored' END AS kind, conf AS confidence, sharpness, score AS quality_score, quality_class, completeness, fence_score, c_x1 AS crop_x1 FROM cd UNION ALL "
    "SELECT photo_id, 2000000000, 'fallback', CASE WHEN sharp < 95 OR fence THEN 'reject' ELSE 'accept' END, CASE WHEN sharp < 95 THEN 'fallback_too_soft_after_' WHEN fence THEN 'fallback_fence_after_' ELSE 'whole_image_fallback_after_' END || after, "
    "CASE WHEN sharp < 95 OR fence THEN 'whole' ELSE 'whole_kept' END, NULL, sharp, 50.0, 'review', NULL, NULL, NULL FROM wh UNION ALL "
    "SELECT photo_id, 2000000001, NULL, 'reject', 'batch_predict_exception: photo ' || photo_id, 'error', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lost), "
    f"kn AS (SELECT * FROM (VALUES {_KINDS}) v(kind, k, name)), fi AS (SELECT kind, min(photo_id::DOUBLE * 1e10 + place) AS seen FROM ro GROUP BY 1), "
    "hd AS (SELECT string_agg(name, ',' ORDER BY seen, k) AS header FROM (SELECT name, seen, k FROM kn JOIN fi USING (kind) QUALIFY row_number() OVER (PARTITION BY name ORDER BY seen, k) = 1)) "
    "SELECT photo_id, candidate_idx, decision, reason, header, "
    + ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM kn WHERE kn.kind = ro.kind AND kn.name = '{x}') THEN {x} END AS {x}" for x in _IN_REPORT)
    + " FROM ro, hd"
)
def report_file(spark, sf_dir):
    """Accepted, rejected, whole and error rows in one file, read back by its own header."""
    photos = fixture.photos(spark, sf_dir)
    errors = settled(photo_files.predict_errors(photo_files.detect(photos.select("photo_id"), _stub_model, SETTINGS)))
    left = _dets(spark, sf_dir).join(errors.select("photo_id"), "photo_id", "left_anti")
    decisions = settled(D.report_columns(D.decide(left, FALLBACK, lean=True), FALLBACK))  # no keypoints, which are most of a decision's bytes
    looked = photos.join(errors.select("photo_id"), "photo_id", "left_anti").withColumns({"photo_sharpness": (F.col("photo_id") % 200).cast("double"), "photo_fence": F.col("photo_id") % 7 == 0})
    whole = D.fallback(looked, decisions, FALLBACK).join(looked.select("photo_id", "photo_sharpness"), "photo_id")
    path = shared_folder(spark, "report")
    sinks.write_report(decisions, path, FALLBACK, whole, errors)
    lines = spark.read.option("lineSep", "\r\n").text(path)
    first = F.regexp_replace("value", "^\ufeff", "").startswith("image,")  # Spark's reader drops the mark itself
    said = lines.filter(first).select(F.regexp_replace("value", "^\ufeff", "")).first()[0]
    rows = lines.filter(~first).select(F.from_csv("value", ", ".join(f"{n} string" for n in said.split(","))).alias("x")).select("x.*")
    typed = {n: F.col(n).cast("double") for n in _IN_REPORT if n != "quality_class"}
    return rows.withColumns(typed).select(F.col("image").cast("long").alias("photo_id"), "candidate_idx", "decision", "reason", F.lit(said).alias("header"), *_IN_REPORT)
