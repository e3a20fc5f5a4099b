"""Decisions with a costly stage for those candidates only that it can still change.

A fence can only lower a score. So a candidate is first scored as if there were none; where even this
ceiling is under every line that is saved, or a cheaper gate has stopped it before, its fence is
never looked at. The plan has two branches: what is decided without the costly stage, and the survivors
joined to its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import scoring as S
from sightline.operators import decide as D
from sightline.operators.tables import settled

_FENCE = ("fence_score", "fence_detected")


def with_ceiling(dets: DataFrame, s: dict) -> DataFrame:
    """Candidates without fence figures, with all parts of the score but that of the fence, and the ceiling."""
    parts = S.components(s, S.number(S.NO_FENCE))
    out = D.prepared(dets, s).selectExpr("*", *(f"{text} AS part_{n}" for n, text in parts.items()))
    out = out.selectExpr("*", f"{S.raw_score(s, {n: f'part_{n}' for n in parts})} AS raw_ceiling")
    return D.as_rows(out.selectExpr("* EXCEPT (raw_ceiling)", f"{G.rounded_text('raw_ceiling', 2)} AS ceiling"))


def with_fence(rows: DataFrame, s: dict) -> DataFrame:
    """Adds the fence's part and the score to rows that have their fence figures."""
    names = [c.removeprefix("part_") for c in rows.columns if c.startswith("part_")]
    rows = rows.selectExpr("* EXCEPT (part_fence_free)", f"{S.fence_free('fence_score')} AS part_fence_free")
    rows = rows.selectExpr("*", f"{S.raw_score(s, {n: f'part_{n}' for n in names})} AS raw_score")
    return rows.selectExpr("*", f"{G.rounded_text('raw_score', 2)} AS score")


def decide_staged(dets: DataFrame, s: dict, fences: Callable[[DataFrame], DataFrame], *, lean: bool = False) -> DataFrame:
    """As ``decide``, for ``dets`` without fence figures.

    ``fences`` gives photo_id, candidate_idx, fence_score and fence_detected for each row that it gets: candidates that
    need it, with their crop. Rows that never get there have null figures and no score. The rows before the costly stage are
    made once, as a written table that both branches read. With ``lean`` the keypoints and the photo's other detections, which no decision
    reads any more, are neither written nor in the result.
    """
    rows = with_ceiling(dets.drop(*_FENCE), s).withColumn("needs_fence", F.coalesce(D.needs_fence(s), F.lit(False)))
    rows = settled(rows.drop(*D.DONE) if lean else rows)
    waiting = rows.filter("needs_fence")
    measured = waiting.join(fences(waiting).select("photo_id", "candidate_idx", *_FENCE), ["photo_id", "candidate_idx"])
    known = rows.filter(~F.col("needs_fence")).withColumns({"fence_score": F.lit(None).cast("double"), "fence_detected": F.lit(None).cast("boolean")})
    both = known.select(rows.columns + list(_FENCE)).unionByName(measured.select(rows.columns + list(_FENCE)))
    return D.finished(with_fence(both, s), s)
