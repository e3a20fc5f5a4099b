"""From images to decisions, on made images: figures of each candidate, errors that stay with their row, counters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import config
from sightline.operators import decide as D
from sightline.operators import measure as M
from sightline.operators import pixels as P

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
SETTINGS = config.merged({"selection_filters": {"min_box_height_px": 20, "min_height_ratio": 0.05}})


def noisy(seed, h=300, w=420, channels=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, channels), dtype=np.uint8)


def frame(spark, images):
    rows = [((name, x.shape[0], x.shape[1], x.shape[2], 16, x.tobytes()) if x is not None else (name, -1, -1, -1, -1, b""),) for name, x in images.items()]
    return spark.createDataFrame(rows, f"image {IMAGE}")


def candidates(spark, rows):
    kps = [(0.0, 0.0, 0.0)] * 17
    rows = [(name, k, 420.0, 300.0, *map(float, box), 0.9, kps) for name, k, box in rows]
    return spark.createDataFrame(rows, "photo_id string, candidate_idx int, w double, h double, x1 double, y1 double, x2 double, y2 double, conf double, kps array<struct<x:double,y:double,conf:double>>")


def test_area_means():
    x = np.arange(24, dtype=float).reshape(4, 6)
    assert np.allclose(P.area_resized(x, 2, 3), x.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    assert P.area_resized(x, 3, 5).mean() == pytest.approx(x.mean())


def test_photos_before_detection(spark):
    flat, dark = np.full((300, 420, 3), 128, np.uint8), np.zeros((300, 420, 3), np.uint8)
    grains = np.kron(noisy(1, 50, 70), np.ones((6, 6, 1), np.uint8))
    got = P.measure_images(frame(spark, {"a": grains, "b": flat, "c": dark, "d": None}))
    rows = {r.photo_id: r for r in got.collect()}
    assert (rows["a"].w, rows["a"].h) == (420, 300) and rows["d"].w is None
    small = np.rint(P.area_resized(grains, 256, 256))
    g = np.rint(small[..., 0] * 0.114 + small[..., 1] * 0.587 + small[..., 2] * 0.299)
    assert rows["a"].brightness == pytest.approx(g.mean()) and rows["a"].sharpness == pytest.approx(P.laplacian(g).var())
    rejects = {r.photo_id: r.reason for r in P.photo_rejects(got, SETTINGS).collect()}
    assert rejects == {"b": "pre_check_failed", "c": "pre_check_failed", "d": "cv2_read_failed"}


def test_relative_box():
    assert P.relative_box((10, 20, 50, 60), (5, 5, 45, 65), 40, 60) == (5, 15, 40, 55)
    assert P.relative_box((0, 0, 3, 3), (5, 5, 45, 65), 40, 60) == (0, 0, 1, 1)


def test_images_to_decisions(spark):
    images = {"a": noisy(2), "b": noisy(3), "c": None}
    rows = [("a", 0, (150, 40, 260, 280)), ("a", 1, (20, 100, 60, 160)), ("b", 0, (180, 30, 250, 200)), ("c", 0, (100, 50, 200, 250))]
    found = M.measured(frame(spark, images).repartition(2), candidates(spark, rows), SETTINGS)
    got = {(r.photo_id, r.candidate_idx): r for r in found.collect()}
    assert len(got) == 4 and got["c", 0].error == "cv2_read_failed" and got["c", 0].sharpness is None
    crops = {(r.photo_id, r.candidate_idx): r for r in M.with_crops(candidates(spark, rows), SETTINGS).collect()}
    for key in (("a", 0), ("a", 1), ("b", 0)):
        c, r = crops[key], got[key]
        g = np.rint(P.gray(images[key[0]]))
        part = P.roi(g, (c.crop.x1, c.crop.y1, c.crop.x2, c.crop.y2))
        assert r.brightness == pytest.approx(part.mean()) and r.error is None
        assert r.sharpness == pytest.approx(P.subject_sharpness(g, (c.region.x1, c.region.y1, c.region.x2, c.region.y2)))
    decided = D.decide(found.filter("error is null"), SETTINGS)
    reasons = {(r.photo_id, r.candidate_idx): r.reason for r in decided.collect()}
    assert set(reasons) == set(got) - {("c", 0)} and all(reasons.values())
    photos = spark.createDataFrame([(x,) for x in "abcd"], "photo_id string")
    rejects = spark.createDataFrame([("c", "reject", "cv2_read_failed"), ("d", "reject", "pre_check_failed")], "photo_id string, decision string, reason string")
    n = {r.counter: r.n for r in D.tally(decided, photos, rejects).collect()}
    assert tuple(sorted(n)) == tuple(sorted(D.TALLY)) and (n["total_images"], n["images_with_person"], n["errors"], n["pre_check_rejected"], n["no_person"]) == (4, 2, 1, 1, 0)
    assert n["processed_crops"] == decided.filter(F.col("decision") == "accept").count()
