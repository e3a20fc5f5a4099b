"""DuckDB text that all oracles start from: the fixture's candidates and their features, step by step.

Written apart from the column expressions: lists and scalar SQL over the same tables.
"""

from sightline.sources.fixture import LAYOUT

_FX = "[" + ", ".join(str(x) for x, _ in LAYOUT) + "]"
_FY = "[" + ", ".join(str(y) for _, y in LAYOUT) + "]"

#: The sum of the weights as doubles add up.
_WEIGHTS = repr(0.0 + 0.3 + 0.12 + 0.16 + 0.12 + 0.08 + 0.1 + 0.12)


def _hundredths(x: str) -> str:
    """A double to two decimals by its binary value, halves to even: the error of the product is taken from its split halves."""
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    over = f"(({x} * 100 - floor({x} * 100) - 0.5::DOUBLE) + (({high} * 100 - {x} * 100) + ({x} - {high}) * 100))"
    return f"(floor({x} * 100) + CASE WHEN {over} > 0 OR ({over} = 0 AND floor({x} * 100) % 2 <> 0) THEN 1 ELSE 0 END) / 100.0::DOUBLE"


BASE = f"""
WITH d0 AS (
  SELECT l_orderkey AS photo_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS candidate_idx,
    l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber * 101 AS k, CAST(floor(l_extendedprice) AS BIGINT) AS ep
  FROM lineitem),
d1 AS (
  SELECT *, 6192.0::DOUBLE AS w, 4128.0::DOUBLE AS h, 300 + k % 3829 AS bh, k * 13 % 6192 AS cx, k * 29 % 1000 AS yr,
    CAST(330 + ep % 650 AS DOUBLE) / 1000.0::DOUBLE AS conf, CAST(ep % 520 AS DOUBLE) AS sharpness, CAST(ep % 211 AS DOUBLE) AS brightness,
    CAST((k * 7) % 40 AS DOUBLE) / 100.0::DOUBLE AS fence_score, (k * 7) % 40 >= 35 AS fence_detected
  FROM d0),
d2 AS (SELECT *, greatest(1, bh * 2 // 5) AS bw, CAST(least(4128 - bh, yr * (4128 - bh) // 900) AS DOUBLE) AS y1 FROM d1),
d3 AS (
  SELECT *, CAST(greatest(0, cx - bw // 2) AS DOUBLE) AS x1, CAST(least(6192, cx + bw // 2) AS DOUBLE) AS x2, y1 + bh AS y2,
    list_transform(range(17), lambda i: (k + i * 37) % 100 < CASE WHEN k % 10 = 0 THEN 20 ELSE 96 END) AS v
  FROM d2),
d4 AS (
  SELECT *, list_transform(range(1, 18), lambda i: x1 + ({_FX}[i])::DOUBLE * (x2 - x1)) AS kx, list_transform(range(1, 18), lambda i: y1 + ({_FY}[i])::DOUBLE * (y2 - y1)) AS ky,
    len(list_filter(v, lambda b: b)) AS n_seen, v[1] OR v[2] OR v[3] OR v[4] OR v[5] AS head, v[6] AND v[7] AS both_sh, v[6] OR v[7] AS any_sh,
    v[12] OR v[13] AS hips, v[14] OR v[15] AS knees, v[16] OR v[17] AS ankles, y1 <= 6 AS cut_top, x1 <= 6 OR x2 >= w - 6 AS cut_side
  FROM d3),
d5 AS (
  SELECT *, NOT cut_side AND NOT cut_top AND ((y2 - y1) / h >= 0.70 OR (x2 - x1) * (y2 - y1) / (w * h) >= 0.34) AS full_frame,
    head OR both_sh AS upper_ok, hips OR knees OR ankles AS lower_ok,
    list_filter(range(1, 18), lambda i: v[i]) AS seen
  FROM d4),
d6 AS (
  SELECT *,
    CASE WHEN NOT full_frame AND ((x1 + x2) / 2 < w * 0.12 OR (x1 + x2) / 2 > w * 0.88) THEN 'unsafe_edge'
         WHEN NOT full_frame AND y2 - y1 < greatest(h * 0.15, 220) THEN 'too_small'
         WHEN NOT full_frame AND n_seen < 4 THEN 'too_few_keypoints' END AS gate,
    upper_ok AND lower_ok AND NOT cut_top AND NOT cut_side AS whole,
    CASE WHEN upper_ok AND lower_ok AND NOT cut_top AND cut_side THEN 'truncated_side' WHEN lower_ok AND NOT upper_ok THEN 'partial_lower_body'
         WHEN cut_top THEN 'truncated_head' WHEN NOT upper_ok THEN 'no_upper_body' WHEN NOT lower_ok THEN 'no_lower_body' END AS part_reason,
    round((head::INT + any_sh::INT + hips::INT + knees::INT + ankles::INT) / 5.0::DOUBLE, 3) AS completeness,
    CASE WHEN n_seen >= 4 THEN least(x1, list_min(list_transform(seen, lambda i: kx[i]))) ELSE x1 END AS rx1,
    CASE WHEN n_seen >= 4 THEN least(y1, list_min(list_transform(seen, lambda i: ky[i]))) ELSE y1 END AS ry1,
    CASE WHEN n_seen >= 4 THEN greatest(x2, list_max(list_transform(seen, lambda i: kx[i]))) ELSE x2 END AS rx2,
    CASE WHEN n_seen >= 4 THEN greatest(y2, list_max(list_transform(seen, lambda i: ky[i]))) ELSE y2 END AS ry2,
    CASE WHEN v[6] AND v[7] THEN (ky[6] + ky[7]) / 2 WHEN v[6] THEN ky[6] WHEN v[7] THEN ky[7] END AS sh_y,
    CASE WHEN v[12] AND v[13] THEN (ky[12] + ky[13]) / 2 WHEN v[12] THEN ky[12] WHEN v[13] THEN ky[13] END AS hip_y
  FROM d5),
d7 AS (
  SELECT *, greatest(1.0, ry2 - ry1) AS ph, CASE WHEN hip_y > sh_y THEN hip_y - sh_y END AS torso,
    list_min(list_transform(list_filter(seen, lambda i: i <= 5), lambda i: ky[i])) AS head_y,
    list_max(list_transform(list_filter(seen, lambda i: i IN (14, 15)), lambda i: ky[i])) AS knee_y,
    list_max(list_transform(list_filter(seen, lambda i: i >= 16), lambda i: ky[i])) AS ankle_y,
    list_max(list_transform(list_filter(seen, lambda i: i IN (12, 13)), lambda i: ky[i])) AS low_hip_y
  FROM d6),
d8 AS (
  SELECT *,
    CASE WHEN head_y IS NOT NULL THEN least(ry1, head_y - ph * 0.06::DOUBLE) WHEN sh_y IS NOT NULL THEN least(ry1, sh_y - ph * 0.22::DOUBLE) ELSE ry1 END AS head_top,
    CASE WHEN ankle_y IS NOT NULL THEN greatest(ry2, ankle_y)
         WHEN knee_y IS NOT NULL THEN greatest(ry2, knee_y + CASE WHEN torso IS NULL THEN ph * 0.2::DOUBLE ELSE torso * 0.75::DOUBLE END)
         WHEN low_hip_y IS NOT NULL THEN greatest(ry2, low_hip_y + CASE WHEN torso IS NULL THEN ph * 0.45::DOUBLE ELSE torso * 1.55::DOUBLE END)
         ELSE ry2 END AS foot
  FROM d7),
d9 AS (
  SELECT *, head_top - greatest(1.0, foot - head_top) * 0.08::DOUBLE AS a_top, foot + greatest(1.0, foot - head_top) * 0.06::DOUBLE AS a_low, (rx2 - rx1) * (1.0::DOUBLE + 0.12::DOUBLE) AS need_w
  FROM d8),
d10 AS (
  SELECT *, greatest((a_low - a_top) * 0.666::DOUBLE, need_w) AS a_w,
    CASE WHEN (a_low - a_top) * 0.666::DOUBLE < need_w THEN a_top + need_w / 0.666::DOUBLE ELSE a_low END AS a_bottom, (rx1 + rx2) / 2 AS a_cx
  FROM d9),
d11 AS (
  SELECT *, trunc(greatest(0, least(a_cx - a_w / 2, w - 1))) AS sx1, trunc(greatest(0, least(a_top, h - 1))) AS sy1,
    greatest(0, least((x1 + x2) / 2 - h * 0.666::DOUBLE / 2, w - h * 0.666::DOUBLE)) AS fx1
  FROM d10),
d12 AS (
  SELECT *,
    CASE WHEN full_frame THEN round_even(fx1, 0) ELSE sx1 END AS c_x1, CASE WHEN full_frame THEN 0.0 ELSE sy1 END AS c_y1,
    CASE WHEN full_frame THEN round_even(fx1 + h * 0.666::DOUBLE, 0) ELSE trunc(greatest(sx1 + 1, least(a_cx + a_w / 2, w))) END AS c_x2,
    CASE WHEN full_frame THEN h ELSE trunc(greatest(sy1 + 1, least(a_bottom, h))) END AS c_y2
  FROM d11),
iso AS (
  SELECT a.photo_id, a.candidate_idx,
    max(greatest(0, least(a.c_x2, b.x2) - greatest(a.c_x1, b.x1)) * greatest(0, least(a.c_y2, b.y2) - greatest(a.c_y1, b.y1)) / greatest(1, (a.c_x2 - a.c_x1) * (a.c_y2 - a.c_y1))) AS of_crop,
    max(greatest(0, least(a.c_x2, b.x2) - greatest(a.c_x1, b.x1)) * greatest(0, least(a.c_y2, b.y2) - greatest(a.c_y1, b.y1)) / greatest(1, (b.x2 - b.x1) * (b.y2 - b.y1))) AS of_other
  FROM d12 a JOIN d3 b ON a.photo_id = b.photo_id AND a.candidate_idx <> b.candidate_idx GROUP BY ALL),
d13 AS (
  SELECT d12.*, coalesce(of_crop, 0.0) AS of_crop, coalesce(of_other, 0.0) AS of_other,
    abs((x1 + x2) / 2 - (c_x1 + c_x2) / 2) / greatest(1, c_x2 - c_x1) AS off_x, abs((y1 + y2) / 2 - (c_y1 + c_y2) / 2) / greatest(1, c_y2 - c_y1) AS off_y
  FROM d12 LEFT JOIN iso USING (photo_id, candidate_idx)),
d14 AS MATERIALIZED (
  SELECT *, greatest(0.0, least((sharpness - 80) / 270.0::DOUBLE, 1.0)) AS p_sharpness,
    greatest(0.0, least(1.0 - least(1.0, greatest(off_x, off_y) / 0.28::DOUBLE), 1.0)) AS p_center,
    CASE WHEN full_frame THEN 1.0 ELSE greatest(0.0, least((greatest(1, y2 - y1) - h * 0.15::DOUBLE) / (700 - h * 0.15::DOUBLE), 1.0)) END AS p_size,
    CASE WHEN full_frame THEN greatest(0.65::DOUBLE, n_seen / 17.0::DOUBLE) ELSE n_seen / 17.0::DOUBLE END AS p_keypoints,
    greatest(0.0, least(1.0 - greatest(of_crop / 0.25::DOUBLE, of_other / 0.75::DOUBLE), 1.0)) AS p_isolation,
    greatest(0.0, least((conf - 0.33::DOUBLE) / (0.65::DOUBLE - 0.33::DOUBLE), 1.0)) AS p_confidence,
    greatest(0.0, least(1.0 - least(1.0, fence_score / 0.25::DOUBLE), 1.0)) AS p_fence_free
  FROM d13),
d15 AS (
  SELECT *, p_sharpness * 0.3::DOUBLE + p_center * 0.12::DOUBLE + p_size * 0.16::DOUBLE + p_keypoints * 0.12::DOUBLE + p_isolation * 0.08::DOUBLE + p_confidence * 0.1::DOUBLE AS part_sum FROM d14),
d16 AS MATERIALIZED (
  SELECT *, {_hundredths("raw_score")} AS score, {_hundredths("raw_ceiling")} AS ceiling FROM (
    SELECT *, (part_sum + p_fence_free * 0.12::DOUBLE) / {_WEIGHTS}::DOUBLE * 100 AS raw_score, (part_sum + 0.12::DOUBLE) / {_WEIGHTS}::DOUBLE * 100 AS raw_ceiling FROM d15)),
d17 AS (
  SELECT *, CASE WHEN score >= 73 THEN 'premium' WHEN score >= 60 THEN 'good' WHEN score >= 45 THEN 'review' ELSE 'reject' END AS class1 FROM d16),
d18 AS (
  SELECT *, CASE WHEN class1 = 'premium' AND sharpness < 180 THEN 'good' ELSE class1 END AS class2 FROM d17),
f AS (
  SELECT *, CASE WHEN NOT full_frame AND NOT whole AND class2 IN ('premium', 'good') THEN 'review' ELSE class2 END AS class3,
    CASE WHEN NOT full_frame AND NOT whole AND class2 IN ('premium', 'good') THEN part_reason WHEN class2 <> class1 THEN 'soft_for_premium' END AS demoted
  FROM d18)
"""


def decided(fast: bool = True, premium_only: bool = False, save_review: bool = False, name: str = "decided") -> str:
    """CTE ``decided`` on top of BASE."""
    floor = 73 if premium_only else 60
    prune = fast and (premium_only or not save_review)
    steps = ["WHEN gate IS NOT NULL THEN gate"]
    if prune:
        steps.append("WHEN NOT full_frame AND NOT whole THEN 'skipped_' || part_reason")
    steps.append("WHEN sharpness < 80 THEN 'blurred'")
    if prune and premium_only:
        steps.append("WHEN sharpness < 180 THEN 'skipped_soft'")
    if prune:
        steps.append(f"WHEN ceiling < {floor} THEN 'skipped_score'")
    steps.append("WHEN fence_detected THEN 'fence_detected'")
    kept = "class3 = 'premium'" if premium_only else ("class3 IN ('premium', 'good')" + (" OR class3 = 'review' OR (class3 = 'reject' AND score >= 62)" if save_review else ""))
    steps.append(f"WHEN NOT ({kept}) THEN 'low_quality_score'")
    return f"""{BASE}, {name} AS (
  SELECT *, CASE WHEN reason = 'ok' THEN 'accept' ELSE 'reject' END AS decision,
    CASE WHEN reason = 'ok' AND class3 = 'reject' THEN 'review' WHEN reason IN ('ok', 'low_quality_score') THEN class3 END AS quality_class,
    CASE WHEN reason IN ('ok', 'low_quality_score') THEN demoted END AS demoted_reason
  FROM (SELECT *, CASE {' '.join(steps)} ELSE 'ok' END AS reason FROM f))
"""
