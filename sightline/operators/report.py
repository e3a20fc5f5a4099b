"""The report's rows: one line per decision, with the columns that its kind of row has.

Rows of gates, of measured candidates, of whole photos and of errors have different columns. The header lists each
column where the first row that has it puts it, so it depends on the rows; only the kinds of
rows and the first row of each are looked at for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The report's columns by kind of row, in order.
_BOX = ["image", "candidate_idx", "confidence", "box_x1", "box_y1", "box_x2", "box_y2", "box_height", "is_full_frame", "decision", "reason"]
_SCORE = ["quality_score", "quality_class", "demoted_reason", "completeness", "has_upper_body", "truncated_top"]
KINDS: dict[str, list[str]] = {
    "gate": _BOX,
    "pose": [*_BOX, "visible_keypoints"],
    "early": [*_BOX, "completeness"],
    "soft": [*_BOX, "sharpness"],
    "fence": [*_BOX, "fence_detected", "fence_score"],
    "scored": [*_BOX, "sharpness", *_SCORE],
    "accepted": [*_BOX, "sharpness", *_SCORE, "enhancement_candidate_reason", "enhance_mode", "crop_x1", "crop_y1", "crop_x2", "crop_y2", "output_path"],
    "whole": ["image", "candidate_idx", "decision", "reason", "sharpness"],
    "whole_kept": ["image", "candidate_idx", "decision", "reason", "quality_score", "quality_class", "is_full_frame", "sharpness"],
    "error": ["image", "decision", "reason"],
}


def kind_of(decision: Column, reason: Column) -> Column:
    """The kind of a candidate's row."""
    return (
        F.when(decision == "accept", "accepted")
        .when(reason == "too_few_keypoints", "pose")
        .when(reason.isin("unsafe_edge", "too_small", "no_frontal_face", "crop_failed"), "gate")
        .when(reason.isin("blurred", "skipped_soft", "skipped_score"), "soft")
        .when(reason.startswith("skipped_"), "early")
        .when(reason == "fence_detected", "fence")
        .otherwise("scored")
    )


def report_rows(candidates: DataFrame, kept_whole: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """All rows in one table: ``kind``, ``place`` (order within a photo) and every column, null where a kind hasn't it.

    ``candidates`` has photo_id, candidate_idx and the report's columns; ``kept_whole`` are the fallback's rows
    (with photo_sharpness, if it is known), whose index is the word fallback; ``errors`` have photo_id, decision and reason.
    """
    found = candidates.withColumns({"kind": kind_of(F.col("decision"), F.col("reason")), "place": F.col("candidate_idx").cast("int")})
    parts = [found.withColumn("candidate_idx", F.col("candidate_idx").cast("string"))]
    if kept_whole is not None:
        kept = F.col("decision") == "accept"
        more = {
            "kind": F.when(kept, "whole_kept").otherwise("whole"), "place": F.lit(2**30), "candidate_idx": F.lit("fallback"), "is_full_frame": F.lit(True),
            "reason": F.when(kept, F.concat(F.lit("whole_image_"), F.col("reason"))).otherwise(F.col("reason")),
            "quality_score": F.col("score"), "quality_class": F.when(F.col("score") == 50.0, "review").otherwise("good"),
        }
        if "photo_sharpness" in kept_whole.columns:
            more["sharpness"] = F.round("photo_sharpness", 2)
        parts.append(kept_whole.withColumns(more).drop("after", "score", "photo_sharpness"))
    if errors is not None:
        parts.append(errors.select("photo_id", "decision", "reason", F.lit("error").alias("kind"), F.lit(2**30 + 1).alias("place")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.withColumn("image", F.col("photo_id").cast("string"))
    names = list(dict.fromkeys(n for columns in KINDS.values() for n in columns if n in out.columns))
    held = {n: F.when(F.col("kind").isin(*(k for k, columns in KINDS.items() if n in columns)), F.col(n)) for n in names}
    return out.withColumns(held).select("photo_id", "place", "kind", *names)


def header(rows: DataFrame) -> list[str]:
    """Columns as the rows bring them, first seen first."""
    first = rows.groupBy("kind").agg(F.min(F.struct("photo_id", "place")).alias("at")).orderBy("at").select("kind").collect()
    return list(dict.fromkeys(n for r in first for n in KINDS[r.kind] if n in rows.columns))


def line(rows: DataFrame, names: list[str]) -> Column:
    """A row as a line of CSV; what a row hasn't is empty, and truth values are written as words with a capital."""
    said = [F.when(F.col(n), "True").otherwise(F.when(~F.col(n), "False")).alias(n) if rows.schema[n].dataType == T.BooleanType() else F.col(n) for n in names]
    return F.to_csv(F.struct(*said), {"emptyValue": "", "nullValue": "", "escape": '"'})
