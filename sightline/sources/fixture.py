"""Photos and detections made from ``orders`` and ``lineitem`` by integer arithmetic, where there are no images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.operators.decide import with_others

# Places of the 17 keypoints in a person's box, as shares of its sides.
LAYOUT = [
    (0.5, 0.07), (0.46, 0.06), (0.54, 0.06), (0.42, 0.07), (0.58, 0.07), (0.35, 0.20), (0.65, 0.20), (0.30, 0.35), (0.70, 0.35),
    (0.30, 0.48), (0.70, 0.48), (0.40, 0.50), (0.60, 0.50), (0.40, 0.72), (0.60, 0.72), (0.40, 0.95), (0.60, 0.95),
]
WIDTH, HEIGHT = 6192, 4128


def detections(spark: SparkSession, sf_dir: str, *, in_order: bool = False) -> DataFrame:
    """One row per detected person: photo_id, candidate_idx, w, h, box, conf, kps, sharpness and fence figures, and ``dets``, the boxes of the photo's detections.

    With ``in_order`` parts are ranges of photos. A result sorted by photo then needs no shuffle at its end, whose
    ranges Spark would find by computing all of it one time more.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = lines.selectExpr("l_orderkey AS photo_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    if in_order:
        d = d.repartitionByRange("photo_id")
    # the key has its last name before the window and all else comes after it: the next window by photo then needs no other shuffle, and this one moves five columns
    d = d.selectExpr("*", "CAST(row_number() OVER (PARTITION BY photo_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS candidate_idx")
    d = d.selectExpr("photo_id", "candidate_idx", "photo_id * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber * 101 AS k", "CAST(floor(l_extendedprice) AS BIGINT) AS ep")
    d = d.selectExpr("*", f"CAST({WIDTH} AS DOUBLE) AS w", f"CAST({HEIGHT} AS DOUBLE) AS h", "300 + k % 3829 AS bh", f"k * 13 % {WIDTH} AS cx", "k * 29 % 1000 AS yr", "(330 + ep % 650) / 1000.0D AS conf", "CAST(ep % 520 AS DOUBLE) AS sharpness", "CAST(ep % 211 AS DOUBLE) AS brightness")
    d = d.selectExpr("*", "greatest(1, bh * 2 DIV 5) AS bw", f"CAST(least({HEIGHT} - bh, yr * ({HEIGHT} - bh) DIV 900) AS DOUBLE) AS y1")
    d = d.selectExpr("*", "CAST(greatest(0, cx - bw DIV 2) AS DOUBLE) AS x1", f"CAST(least({WIDTH}, cx + bw DIV 2) AS DOUBLE) AS x2", "y1 + bh AS y2")
    d = with_others(d)  # before the keypoints, which are most of a row's bytes
    points = ", ".join(f"struct(x1 + {fx}D * (x2 - x1) AS x, y1 + {fy}D * (y2 - y1) AS y, CASE WHEN (k + {i} * 37) % 100 < (CASE WHEN k % 10 = 0 THEN 20 ELSE 96 END) THEN 0.9D ELSE 0.05D END AS conf)" for i, (fx, fy) in enumerate(LAYOUT))
    return d.selectExpr(
        "photo_id", "candidate_idx", "w", "h", "x1", "y1", "x2", "y2", "conf", f"array({points}) AS kps", "sharpness", "brightness",
        "CAST((k * 7) % 40 AS DOUBLE) / 100.0D AS fence_score", "(k * 7) % 40 >= 35 AS fence_detected", "dets",
    )


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per photo, those without a detection too."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS photo_id", f"CAST({WIDTH} AS DOUBLE) AS w", f"CAST({HEIGHT} AS DOUBLE) AS h").distinct()
