"""From photos and detections to the figures that decisions need: one job over the images.

Each photo meets its own candidates, an array that a detector bounds, and is looked at once in a
task. What is measured joins the candidates again by number, so ``decide`` can follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import scoring as S
from sightline.operators import pixels as P

_SIDES = ("x1", "y1", "x2", "y2")
_FIGURES = "photo_id string, candidate_idx int, sharpness double, brightness double, lines int, person double, central double, coverage double, error string"


def with_crops(candidates: DataFrame, s: dict) -> DataFrame:
    """Adds ``full_frame``, ``crop`` and the ``region`` whose focus counts."""
    out = G.with_smart_crop(candidates.withColumn("full_frame", G.is_full_frame(s)), s)
    return out.withColumn("crop", F.when(F.col("full_frame"), G.full_frame_crop(s)).otherwise(F.col("smart_crop"))).drop("smart_crop").withColumn("region", G.subject_region(s))


def figures(image: np.ndarray, candidate: dict, s: dict) -> tuple:
    """Sharpness, brightness and fence figures of one candidate; fences in the crop's own pixels."""
    g = np.rint(P.gray(image)) if image.ndim == 3 else image.astype(float)
    crop, box, region = (tuple(candidate[k][x] for x in _SIDES) for k in ("crop", "box", "region"))
    part = P.roi(g, crop)
    return P.subject_sharpness(g, region), float(part.mean()), *P.fence_figures(part, P.relative_box(box, crop, part.shape[1], part.shape[0]), s)


def measured(images: DataFrame, candidates: DataFrame, s: dict) -> DataFrame:
    """``candidates`` with ``sharpness``, ``brightness``, ``fence_score``, ``fence_detected``, and ``error`` where a photo or a candidate couldn't be measured.

    ``images`` are rows of the ``image`` source, whose origin is the candidates' ``photo_id``. An error stays with its row; no other photo is lost by it.
    """
    prep = with_crops(candidates, s)
    one = F.struct("candidate_idx", "crop", "region", F.struct(*_SIDES).alias("box"))
    gathered = prep.groupBy("photo_id").agg(F.collect_list(one).alias("found"))
    joined = images.select(F.col("image.origin").alias("photo_id"), "image").join(gathered, "photo_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FIGURES.split(", ")]
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
        for batch in batches:
            for i in range(batch.num_rows):  # a photo at a time
                out, image = [], P.decoded(batch.column("image")[i].as_py())
                for c in batch.column("found")[i].as_py():
                    try:
                        made = (*figures(image, c, s), None) if image is not None else (None,) * 6 + ("cv2_read_failed",)
                    except Exception as e:  # one row's fault is that row's result
                        made = (None,) * 6 + (f"exception: {e}",)
                    out.append((batch.column("photo_id")[i].as_py(), c["candidate_idx"], *made))
                if out:
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

    found = joined.mapInArrow(rows, _FIGURES)
    fence = S.fence_decision(s, F.col("lines"), F.col("person"), F.col("central"), F.col("coverage"))
    found = found.select("photo_id", "candidate_idx", "sharpness", "brightness", fence["score"].alias("fence_score"), fence["detected"].alias("fence_detected"), "error")
    return candidates.join(found, ["photo_id", "candidate_idx"], "left")
