"""Every registered query of the selection engine against its DuckDB text, and rules at their boundaries."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline import config
from sightline.functions import geometry as G
from sightline.functions import keypoints as K
from sightline.functions import scoring as S
from sightline.operators import decide as D
from sightline.operators import pixels as P
from sightline.plans import core_queries
from sightline.sources import fixture
from sightline.sources import photos as photo_files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(tuple, frame.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(core_queries.QUERIES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got, want = core_queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(core_queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))
    assert len(got)


def person(spark, box, confs=(0.9,) * 17, **more):
    x1, y1, x2, y2 = box
    kps = [(x1 + fx * (x2 - x1), y1 + fy * (y2 - y1), c) for (fx, fy), c in zip(fixture.LAYOUT, confs, strict=True)]
    row = {"photo_id": 1, "candidate_idx": 0, "w": 6192.0, "h": 4128.0, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "conf": 0.9, "kps": kps, "sharpness": 400.0, "brightness": 100.0, "fence_score": 0.0, "fence_detected": False} | more
    schema = "photo_id long, candidate_idx int, w double, h double, x1 double, y1 double, x2 double, y2 double, conf double, kps array<struct<x:double,y:double,conf:double>>, sharpness double, brightness double, fence_score double, fence_detected boolean"
    return spark.createDataFrame([row], schema)


def outcome(spark, box, s=None, **more):
    return D.decide(person(spark, box, **more), s or config.merged(None)).first()


def test_border_of_six_pixels(spark):
    cut, whole = outcome(spark, (4000.0, 500.0, 6186.0, 4000.0)), outcome(spark, (4000.0, 500.0, 6185.0, 4000.0))
    assert not cut.full_frame and cut.reason == "skipped_truncated_side"
    assert whole.full_frame and whole.decision == "accept"
    free = config.merged({"completeness_guard": {"edge_truncation_guard": False}})
    assert outcome(spark, (4000.0, 500.0, 6186.0, 4000.0), free).full_frame


def test_reasons_that_the_fixture_lacks(spark):
    slow = config.merged({"performance": {"fast_path": False}, "quality_scoring": {"save_review": True}})
    box = (2500.0, 800.0, 3300.0, 2800.0)
    assert outcome(spark, box, confs=(0.05,) * 13 + (0.9,) * 4).reason == "skipped_partial_lower_body"
    bare = (0.05,) * 5 + (0.9, 0.05, 0.9, 0.9, 0.9, 0.9) + (0.05,) * 6
    assert D.prepared(person(spark, box, bare), slow).first().complete.reason == "no_upper_body"
    assert D.prepared(person(spark, box, (0.9,) * 11 + (0.05,) * 6), slow).first().complete.reason == "no_lower_body"
    face = config.merged({"selection_filters": {"require_frontal_face": True}})
    assert outcome(spark, box, face, confs=(0.4,) + (0.9,) * 16).reason == "no_frontal_face"
    assert outcome(spark, box, kps=None).reason == "too_few_keypoints"


def test_ramp_and_clamp(spark):
    row = spark.range(1).select(
        S.ramp(F.lit(5.0), 0, 10).alias("a"), S.ramp(F.lit(5.0), 10, 10).alias("b"), S.ramp(F.lit(10.0), 10, 3).alias("c"),
        G.clamp(F.lit(5.0), F.lit(7.0), F.lit(3.0)).alias("d"), D.reject_name(F.lit("a b/ü!" + "x" * 80)).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (0.5, 0.0, 1.0, 7.0) and row.e == "a_b_ü_" + "x" * 54


def test_fast_path_saves_what_the_slow_path_saves(spark, sf_dir):
    dets = fixture.detections(spark, sf_dir).filter(F.col("photo_id") < 400).cache()
    draw, total, skipped = random.Random(2026), 0, set()
    for _ in range(6):
        line = draw.choice([45, 60, 73, 85])
        over = {
            "quality_scoring": {"premium_only": draw.random() < 0.5, "save_review": draw.random() < 0.3, "classes": {"premium": line, "good": draw.choice([max(0, line - 13), line + 9])}},
            "completeness_guard": {"review_on_partial": draw.random() < 0.7}, "selection_filters": {"premium_min_sharpness": draw.choice([0, 180, 300])},
        }
        saved = []
        for fast in (True, False):
            s = config.merged({"performance": {"fast_path": fast}}, config.merged(over))
            rows = D.decide(dets, s).select("photo_id", "candidate_idx", "decision", "reason", "quality_class", "score").collect()
            saved.append({(r.photo_id, r.candidate_idx, r.quality_class, r.score) for r in rows if r.decision == "accept"})
            skipped |= {r.reason for r in rows if r.reason.startswith("skipped_")}
        assert saved[0] == saved[1], over
        total += len(saved[0])
    assert total > 500 and {"skipped_score", "skipped_truncated_side"} <= skipped


def test_settings():
    assert config.merged({"crop": {"aspect_ratio": 1}})["crop"]["anatomy_side_margin"] == 0.12
    assert config.DEFAULTS["crop"]["aspect_ratio"] == 0.666
    assert config.saveable_floor(config.merged(None)) == 60
    assert config.saveable_floor(core_queries.PREMIUM) == 73 and config.saveable_floor(core_queries.REVIEW) is None
    assert not config.may_prune(config.merged({"debug": {"save_rejects": True}}))
    assert config.resolved(" a/b ", "/base/") == "/base/a/b" and config.resolved("hdfs://x/y", "/base") == "hdfs://x/y"
    with pytest.raises(ValueError):
        config.resolved("C:a", "/base")


def test_labels_and_fence():
    import numpy as np

    mask = np.array([[1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]], dtype=bool)
    labels = P.components(mask)
    assert labels.max() == 3 and labels[0, 0] == labels[1, 1] == labels[0, 2] != labels[3, 0]
    picture = np.zeros((200, 300))
    picture[:, 20:300:40] = picture[:, 21:300:40] = picture[:, 22:300:40] = 255
    count, person, central, cover = P.fence_figures(picture, (50, 20, 250, 180), config.DEFAULTS)
    assert count == 7 and cover == pytest.approx(21 / 300) and person > 0 and central > 0
    assert P.fence_figures(picture[:40], (0, 0, 9, 9), config.DEFAULTS) == (0, 0.0, 0.0, 0.0)


def test_image_files(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    for name, size in (("a.jpg", 40), ("b.JPG", 64)):
        image = jvm.java.awt.image.BufferedImage(size, 32, jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR)
        for x in range(0, size, 2):
            for y in range(32):
                image.setRGB(x, y, 0xFFFFFF)
        jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / name)))
    (tmp_path / "bad.jpg").write_bytes(b"nothing")
    (tmp_path / "c.Jpg").write_bytes(b"left out")
    measured = {r.photo_id.rsplit("/", 1)[-1]: r for r in P.measure_images(photo_files.images(spark, str(tmp_path))).collect()}
    assert measured["a.jpg"].w == 40 and measured["a.jpg"].sharpness > 100 and 100 < measured["a.jpg"].brightness < 150
    sizes = {r.path.rsplit("/", 1)[-1]: r["size"] for r in photo_files.with_size(photo_files.files(spark, str(tmp_path))).collect()}
    assert sorted(sizes) == ["a.jpg", "b.JPG", "bad.jpg"]
    assert (sizes["b.JPG"].width, sizes["b.JPG"].height) == (64, 32) and sizes["bad.jpg"].width is None


def test_detector_seam_and_visible(spark):
    def model(batches):
        for pdf in batches:
            yield pdf.assign(dets=[[{"box": {"x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 9.0}, "conf": None, "kps": None}] * int(n) for n in pdf.n]).drop(columns=["n"])

    rows = spark.createDataFrame([("a", 2), ("b", 0)], "photo_id string, n int")
    found = photo_files.detect(rows, model, most=1)
    sizes = spark.createDataFrame([("a", 10, 10), ("b", 10, 10)], "photo_id string, w int, h int")
    out = photo_files.candidates(found, sizes).withColumn("seen", K.visible(config.DEFAULTS)).collect()
    assert [(r.photo_id, r.candidate_idx, r.conf, r.seen) for r in out] == [("a", 0, 1.0, 0)]


def test_streamed_photos(spark, tmp_path):
    from sightline.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"1234")
    stream = ingest.photo_stream(spark, str(tmp_path / "in")).select("path", "length")
    q = stream.writeStream.format("memory").queryName("photos_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.length for r in spark.sql("select * from photos_seen").collect()] == [4]


def test_subject_sharpness_and_unsharp():
    import numpy as np

    g = np.random.default_rng(1).random((960, 400)) * 255
    assert P.shrunk(g, 480).shape == (480, 200) and P.shrunk(g, 480).mean() == pytest.approx(g.mean())
    assert np.allclose(P.shrunk(np.repeat(np.repeat(g[:480, :200], 2, 0), 2, 1), 480), g[:480, :200])
    flat = g.copy()
    flat[:, 100:300] = 7.0
    assert P.subject_sharpness(flat, (0, 0, 400, 960)) < P.subject_sharpness(g, (0, 0, 400, 960))
    assert P.roi(g, (-5.0, 959.9, -1.0, 2000.0)).shape == (1, 1)
    step = np.zeros((8, 8, 3), np.uint8)
    step[:, 4:] = 100
    assert P.unsharp(step, "none") is step and P.unsharp(step, "strong")[0, 4, 0] > 100 and P.unsharp(step, "odd").dtype == np.uint8


def test_metadata_and_session(spark):
    from sightline.functions import exif

    tags = {"0th.Orientation": b"6", "0th.Make": b"x", "1st.a": b"y", "thumbnail": b"z", "Exif.MakerNote": b"n" * 65534, "Exif.PixelXDimension": b"9"}
    row = spark.createDataFrame([(tags,)], "tags map<string,binary>").select(exif.kept(F.col("tags"), F.lit(40), F.lit(60)).alias("k")).first()
    assert {k: bytes(v) for k, v in row.k.items()} == {"0th.Make": b"x", "Exif.PixelXDimension": b"40", "Exif.PixelYDimension": b"60"}
    assert config.session_settings(8, 2, 100)["spark.sql.shuffle.partitions"] == "800"


def test_second_pass_takes_promising_crops_or_all_of_review(spark):
    schema = "photo_id long, decision string, quality_class string, enhancement_reason string"
    rows = [(1, "accept", "review", None), (2, "accept", "review", "soft_focus"), (3, "reject", "review", "soft_focus"), (4, "accept", "good", "soft_focus"), (5, "accept", None, None)]
    taken = lambda some: sorted(r["photo_id"] for r in D.second_pass(spark.createDataFrame(some, schema)).collect())
    assert taken(rows) == [2]
    assert taken([r for r in rows if r[0] != 2]) == [1]
    assert taken([]) == []


@pytest.mark.parametrize("most", [1, G.FEW, G.FEW + 1, 2 * G.FEW])
def test_isolation_of_few_and_of_many_detections(spark, most):
    """Both ways, by places and by a function of arrays, against plain loops; ``dets`` null or empty counts as alone."""
    r = random.Random(most)
    rows, want = [], {}
    for photo in range(40):
        boxes = [(float(x := r.randrange(0, 90)), float(y := r.randrange(0, 90)), float(x + r.randrange(0, 60)), float(y + r.randrange(0, 60))) for _ in range(r.randrange(0, most + 1))]
        dets = [(i, *b) for i, b in enumerate(boxes)] if boxes or photo % 2 else None
        crop = (float(r.randrange(0, 50)), 0.0, float(r.randrange(50, 150)), 80.0)
        rows.append((photo, 0, crop, dets))
        of = [[0.0], [0.0]]
        for i, b in enumerate(boxes[1:], 1):
            wide, tall = min(crop[2], b[2]) - max(crop[0], b[0]), min(crop[3], b[3]) - max(crop[1], b[1])
            met = wide * tall if wide > 0 and tall > 0 else 0.0
            for out, (x1, y1, x2, y2) in zip(of, (crop, b)):
                out.append(met / max(1.0, (x2 - x1) * (y2 - y1)))
        want[photo] = tuple(map(max, of))
    box = "x1:double,y1:double,x2:double,y2:double"
    table = spark.createDataFrame(rows, f"photo_id long, candidate_idx int, crop struct<{box}>, dets array<struct<candidate_idx:int,{box}>>")
    got = G.with_isolation(table, "alone")
    assert got.columns == [*table.columns, "alone"]
    assert {x.photo_id: tuple(x.alone) for x in got.collect()} == want
