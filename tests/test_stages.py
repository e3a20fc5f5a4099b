"""The staged plan, suppression, fences from pixels, pixel operations, sinks and the report, each against plain Python or numpy."""

import json
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline import config
from sightline.operators import decide as D
from sightline.operators import enhance, fences, labels, report, sinks, staged, suppress
from sightline.operators import pixels as P
from sightline.plans import photo_queries
from sightline.sources import fixture
from sightline.sources import photos as photo_files

KEY = ["photo_id", "candidate_idx"]


def relation(spark, pictures):
    rows = [(k, *g.shape, r, c, float(g[r, c])) for k, g in pictures.items() for r in range(g.shape[0]) for c in range(g.shape[1])]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["photo_id", "h", "w", "r", "c", "v"]), "photo_id long, h int, w int, r int, c int, v double")


def images(df, pictures=None):
    out = {}
    for r in df.collect():
        out.setdefault(r.photo_id, {})[r.r, r.c] = r.v
    return {k: np.array([[v[r, c] for c in range(max(x for _, x in v) + 1)] for r in range(max(y for y, _ in v) + 1)]) for k, v in out.items()}


NEW = ["fence_areas", "fence_figures", "decisions_staged", "suppression", "batch_isolation", "resampled_smaller", "resampled_larger", "oriented", "equalised", "denoised", "written_crops", "write_tally", "report_file"]


@pytest.fixture(scope="module")
def tables(sf_dir, tmp_path_factory):
    """The tables with fewer pictures."""
    folder, con = tmp_path_factory.mktemp("tables"), duckdb.connect()
    for t, some in (("orders", ""), ("lineitem", ""), ("embeddings", "WHERE vec_id < 60")):
        con.sql(f"COPY (SELECT * FROM '{sf_dir}/{t}.parquet' {some}) TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NEW)
def test_same_rows_as_sql(spark, tables, name):
    want = tables[1].sql(photo_queries.ORACLES[name])
    got = photo_queries.QUERIES[name](spark, tables[0])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(tuple, got.select(*want.columns).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr) and rows


# ---- staged


VARIANTS = [
    {}, {"quality_scoring": {"save_review": True}}, {"completeness_guard": {"enabled": False}},
    {"quality_scoring": {"classes": {"premium": 35, "good": 22, "review": 0}}, "selection_filters": {"premium_min_sharpness": 0}},
    {"quality_scoring": {"premium_only": True, "classes": {"premium": 60, "good": 70, "review": 0}}, "selection_filters": {"premium_min_sharpness": 300, "hard_reject_extreme_blur": False}},
    {"selection_filters": {"hard_reject_fence": False, "premium_min_sharpness": 600}, "completeness_guard": {"edge_truncation_guard": False}}, {"debug": {"save_rejects": True}},
]


@pytest.mark.parametrize("k", range(len(VARIANTS)))
def test_staged_saves_what_the_slow_path_saves(spark, sf_dir, k):
    """1,500 photos a setting: the costly stage sees the survivors alone, and nothing else that is saved changes."""
    fast = config.merged(VARIANTS[k])
    slow = config.merged({"performance": {"fast_path": False}}, fast)
    dets, seen = fixture.detections(spark, sf_dir), []

    def costly(rows):
        seen.append({tuple(r) for r in rows.select(*KEY).collect()})
        return dets.select(*KEY, "fence_score", "fence_detected").join(rows.select(*KEY), KEY)

    got = {(r.photo_id, r.candidate_idx): r for r in staged.decide_staged(dets, fast, costly).collect()}
    want = {(r.photo_id, r.candidate_idx): r for r in D.decide(dets, slow).collect()}
    named = {(r.photo_id, r.candidate_idx): r for r in D.decide(dets, fast).collect()}
    assert got.keys() == want.keys() and len(seen) == 1
    saved = lambda rows: {k: (r.output_name, r.score, r.quality_class, r.crop) for k, r in rows.items() if r.decision == "accept"}
    assert saved(got) == saved(want) and saved(got)
    assert {k: r.reason for k, r in got.items()} == {k: r.reason for k, r in named.items()}
    early = {"unsafe_edge", "too_small", "too_few_keypoints", "blurred"}
    assert seen[0] == {k for k, r in got.items() if r.reason not in early and not r.reason.startswith("skipped_")}
    assert all((r.fence_score is None) == (k not in seen[0]) for k, r in got.items())
    if config.may_prune(fast):
        assert len(seen[0]) < sum(r.reason not in early for r in want.values())
    else:
        assert not any(r.reason.startswith("skipped_") for r in got.values())


def test_a_photo_without_pixels_has_no_crop(spark, sf_dir):
    dets = fixture.detections(spark, sf_dir).filter("photo_id = 1").withColumns({"w": F.lit(0.0), "h": F.lit(0.0)})
    free = config.merged({"selection_filters": {"enable_safe_zone": False, "min_keypoints": 0}, "completeness_guard": {"enabled": False, "edge_truncation_guard": False}, "full_frame_runner": {"enabled": False}})
    rows = D.decide(dets, free)
    assert {r.reason for r in rows.collect()} == {"crop_failed"}
    n = {r.counter: r.n for r in D.tally(rows, dets.select("photo_id").distinct()).collect()}
    assert n["crop_failed"] == rows.count() > 0


# ---- detections


def iou(a, b):
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return inter / max(1e-9, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


@pytest.mark.parametrize(("most", "limit"), [(120, 0.55), (3, 0.3)])
def test_suppression(spark, most, limit):
    s = config.merged({"detector": {"max_det": most, "iou": limit}})
    r, rows = random.Random(most), [("none", []), ("null", None)]
    for k in range(60):
        dets = []
        for _ in range(r.randrange(0, 25)):
            x, y = r.randrange(60), r.randrange(60)
            dets.append(((float(x), float(y), float(x + r.randrange(0, 50)), float(y + r.randrange(0, 50))), r.choice([None, 0.2, 0.33, 0.5, 0.5, 0.9, r.random()])))
        rows.append((f"p{k}", dets))
    kind = "array<struct<box:struct<x1:double,y1:double,x2:double,y2:double>,conf:double>>"
    table = spark.createDataFrame([(n, d if d is None else [(b, c) for b, c in d]) for n, d in rows], f"photo_id string, dets {kind}")
    got = {x.photo_id: x.kept and [(tuple(d.box), d.conf) for d in x.kept] for x in table.select("photo_id", suppress.suppressed(F.col("dets"), s, kind).alias("kept")).collect()}
    for name, dets in rows:
        kept = []
        for box, conf in sorted((d for d in dets or [] if (1.0 if d[1] is None else d[1]) >= 0.33), key=lambda d: -(1.0 if d[1] is None else d[1])):
            if len(kept) < most and all(iou(k, box) <= limit for k, _ in kept):
                kept.append((box, conf))
        assert got[name] == (None if dets is None else kept)


def test_a_failing_photo_fails_alone(spark):
    def model(batches):
        for pdf in batches:
            if (pdf.n < 0).any():
                raise RuntimeError("bad photo")
            yield pdf[pdf.n != 3][["photo_id"]].assign(dets=[[]] * int((pdf.n != 3).sum()))  # leaves a row out

    rows = spark.createDataFrame([(f"p{k}", -1 if k in (5, 6, 70) else 3 if k == 40 else 0) for k in range(100)], "photo_id string, n int").repartition(3)
    found = photo_files.detect(rows, model)
    out = {r.photo_id: r for r in found.collect()}
    assert len(out) == 100 and {k for k, r in out.items() if r.error} == {"p5", "p6", "p70", "p40"}
    assert out["p5"].error == "batch_predict_exception: bad photo" and out["p5"].dets == [] and out["p40"].error.endswith("0 rows for 1")
    assert {r.photo_id for r in photo_files.predict_errors(found).collect()} == {"p5", "p6", "p70", "p40"}


def _with_faults(lost, calls, most=10**9):
    """A model that can't stand some keys, nor more rows than ``most``; notes the rows of each call."""

    def model(batches):
        for pdf in batches:
            calls.append(len(pdf))
            if len(bad := [k for k in pdf.photo_id if k in lost]) or len(pdf) > most:
                raise RuntimeError(f"photo {bad[0]}" if bad else "too many")
            yield pd.DataFrame({"photo_id": pdf.photo_id, "dets": [[k] for k in pdf.photo_id]})

    return model


def _told(lost, sizes, **more):
    calls, at, batches = [], 0, []
    for n in sizes:
        batches.append(pd.DataFrame({"photo_id": range(at, at + n)}))
        at += n
    out = list(photo_files.isolated(_with_faults(lost, calls, **more))(iter(batches)))
    rows = [r for x in out for r in x[["photo_id", "dets", "error"]].astype(object).where(lambda v: v.notna(), None).itertuples(index=False, name=None)]
    assert rows == [(k, None if k in lost else [k], f"batch_predict_exception: photo {k}" if k in lost else None) for k in range(at)]
    return calls, out


def test_a_fault_in_a_hundred_costs_few_calls_and_batches_stay_whole():
    """Halving each batch down to every fault took 15 calls a fault, and as many small batches went back to Spark."""
    lost = {k for k in range(10_000) if k % 100 == 77}
    calls, out = _told(lost, [5_000, 0, 5_000])
    assert len(out) == 2 and len(calls) < 11 * len(lost) and sum(calls) < 60_000


@pytest.mark.parametrize("lost", [set(), {0}, {0, 1, 2}, {62, 63}, set(range(64, 128)), set(range(130)), {k for k in range(130) if k % 2}])
def test_faults_anywhere_are_told_in_order(lost):
    calls, _ = _told(lost, [64, 1, 65])
    assert len(calls) <= 2 * 130 and (lost or calls == [64, 1, 65])


def test_a_model_that_fails_on_large_groups_only_loses_nothing():
    _told({5, 77}, [200, 3], most=7)


# ---- fences


def stripes(seed, h, w):
    r = np.random.default_rng(seed)
    g = r.integers(0, 120, (h, w))
    for _ in range(r.integers(3, 12)):
        a, n, wide = r.integers(0, w), r.integers(h // 8, h + 1), r.integers(1, 6)
        top = r.integers(0, max(1, h - n + 1))
        g[top : top + n, a : a + wide] = 250
    g[r.random((h, w)) < 0.01] = 30
    return g


def test_fences_from_pixels(spark):
    s = config.merged({"fence_detection": {"reject_vertical_line_count": 2}})
    sizes = [(50, 50), (64, 80), (91, 60), (130, 55), (100, 120), (49, 90), (60, 50), (137, 70)]
    pictures = {k: stripes(k, *sizes[k % len(sizes)]) for k in range(24)}
    pictures |= {100: np.full((60, 60), 255), 101: np.zeros((60, 60), int)}
    r = random.Random(3)
    persons = []
    for k, g in pictures.items():
        for j in range(2):
            x, y = r.randrange(g.shape[1] - 5), r.randrange(g.shape[0] - 5)
            persons.append((k, j, x, y, r.randrange(x + 1, g.shape[1] + 1), r.randrange(y + 1, g.shape[0] + 1)))
    table = spark.createDataFrame(persons, "photo_id long, candidate_idx int, px1 int, py1 int, px2 int, py2 int")
    found = fences.figures(relation(spark, pictures), table, s)
    got = {(x.photo_id, x.candidate_idx): x for x in found.collect()}
    assert len(got) == len(persons)
    for k, j, *box in persons:
        want = P.fence_figures(pictures[k].astype(float), tuple(box), s)
        x = got[k, j]
        assert (x.lines, x.person, x.central, x.coverage) == (want[0], pytest.approx(want[1]), pytest.approx(want[2]), pytest.approx(want[3]))
    assert any(x.fence_detected for x in got.values()) and not all(x.fence_detected for x in got.values())
    off = config.merged({"fence_detection": {"enabled": False}})
    assert {(x.lines, x.fence_score, x.fence_detected) for x in fences.figures(relation(spark, {0: pictures[0]}), table.filter("photo_id = 0"), off).collect()} == {(0, 0.0, False)}


def test_areas_are_those_of_a_flood(spark):
    s = config.merged({"fence_detection": {"vertical_kernel_height_ratio": 0.1}})
    pictures = {k: stripes(50 + k, 90, 70) for k in range(4)}
    runs = fences.labelled(fences.opened_runs(relation(spark, pictures), s))
    got = {}
    for x in runs.collect():
        for row in range(x.r0, x.r1 + 1):
            got.setdefault(x.photo_id, {})[row, x.c] = x.label
    for k, mask in got.items():
        grid = np.zeros((90, 70), bool)
        grid[tuple(zip(*mask, strict=True))] = True
        want = P.components(grid)
        assert len({(mask[p], want[p]) for p in mask}) == len(set(mask.values())) == want.max()


def test_connected_over_long_chains(spark):
    edges = [(1, i, i + 1) for i in range(20)] + [(2, 5, 9), (2, 9, 7)]
    nodes = [(1, i) for i in range(23)] + [(2, i) for i in range(10)]
    r = random.Random(1)
    name = list(range(23))
    r.shuffle(name)
    edges = [(p, name[a], name[b]) if p == 1 else (p, a, b) for p, a, b in edges]
    got = {(x.photo_id, x.node): x.label for x in labels.connected(spark.createDataFrame(nodes, "photo_id long, node long"), spark.createDataFrame(edges, "photo_id long, a long, b long")).collect()}
    least = min(name[:21])
    assert all(got[1, name[i]] == least for i in range(21)) and got[1, name[22]] == name[22]
    assert (got[2, 5], got[2, 7], got[2, 9], got[2, 8]) == (5, 5, 5, 8) and len(got) == 33


# ---- pixel operations


def jpeg(order, code, kind=3):
    import struct

    entry = struct.pack(f"{order}HHIHH", 0x0100, 3, 1, 9, 0) + struct.pack(f"{order}HHIHH", 0x0112, kind, 1, code, 0)
    tiff = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(f"{order}I", 8) + struct.pack(f"{order}H", 2) + entry
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"


def test_orientation(spark):
    rows = [(k, jpeg("<>"[k % 2], k)) for k in range(1, 9)] + [(9, jpeg("<", 9)), (10, jpeg(">", 6, kind=4)), (11, b"\xff\xd8\xff\xda"), (12, None), (13, jpeg("<", 6)[:30]), (14, b"")]
    got = {r.k: r.orientation for r in photo_files.with_orientation(spark.createDataFrame(rows, "k int, content binary")).collect()}
    assert got == {k: k if k <= 8 else 1 for k in range(1, 15)}
    g = np.arange(6.0).reshape(2, 3)
    upright = {1: g, 2: g[:, ::-1], 3: g[::-1, ::-1], 4: g[::-1], 5: g.T, 6: np.rot90(g, -1), 7: g[::-1, ::-1].T, 8: np.rot90(g), 0: g}
    made = images(enhance.oriented(relation(spark, {k: g for k in upright}).withColumn("orientation", F.col("photo_id"))))
    assert all(np.array_equal(made[k], want) for k, want in upright.items())


def lanczos(x):
    return np.where(np.abs(x) < 1e-12, 1.0, np.sinc(x) * np.sinc(x / 4)) * (np.abs(x) < 4)


def enlarged(g, m):
    n, out = len(g), np.zeros((m, *g.shape[1:]))
    for o in range(m):
        at = (o + 0.5) * n / m - 0.5
        taps = np.arange(int(np.floor(at)) - 3, int(np.floor(at)) + 5)
        k = lanczos(at - taps)
        out[o] = (k / k.sum()) @ g[np.clip(taps, 0, n - 1)]
    return out


def test_resampling(spark):
    r = np.random.default_rng(2)
    pictures = {0: r.integers(0, 256, (40, 30)), 1: r.integers(0, 256, (9, 7)), 2: r.integers(0, 256, (17, 12)), 3: np.full((33, 21), 7)}
    got = images(enhance.resampled(relation(spark, pictures), 17, 11))
    for k, g in pictures.items():
        want = P.area_resized(g, 17, 11) if len(g) > 17 else enlarged(enlarged(g.astype(float), 17).T, 11).T
        assert got[k].shape == (17, 11) and np.allclose(got[k], want)


def clahe(g, clip, tiles):
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect")
    limit, tables = max(1, int(clip * th * tw / 256)), np.zeros((tiles, tiles, 256))
    for y in range(tiles):
        for x in range(tiles):
            n = np.bincount(full[y * th : (y + 1) * th, x * tw : (x + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            if rest:
                step = max(256 // rest, 1)
                for i in range(0, 256, step):
                    if rest == 0:
                        break
                    n[i], rest = n[i] + 1, rest - 1
            tables[y, x] = np.clip(np.rint(np.cumsum(n) * (255 / (th * tw))), 0, 255)
    out = np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            fy, fx = r / th - 0.5, c / tw - 0.5
            y, x = int(np.floor(fy)), int(np.floor(fx))
            ya, xa = fy - y, fx - x
            at = [[tables[min(max(y + i, 0), tiles - 1), min(max(x + j, 0), tiles - 1), g[r, c]] for j in (0, 1)] for i in (0, 1)]
            out[r, c] = (at[0][0] * (1 - xa) + at[0][1] * xa) * (1 - ya) + (at[1][0] * (1 - xa) + at[1][1] * xa) * ya
    return np.clip(np.rint(out), 0, 255)


def test_local_contrast(spark):
    r = np.random.default_rng(4)
    pictures = {0: r.integers(90, 140, (32, 40)), 1: r.integers(0, 256, (16, 16)), 2: r.integers(100, 110, (30, 27)), 3: np.full((16, 24), 200)}
    for clip, tiles in ((2.0, 4), (40.0, 4)):
        got = images(enhance.equalised(relation(spark, pictures), clip=clip, tiles=tiles))
        for k, g in pictures.items():
            assert np.abs(got[k] - clahe(g, clip, tiles)).max() <= (0 if k in (1, 3) else 1)  # shares that binary fractions do not hold: ties may round either way


def test_denoising(spark):
    r = np.random.default_rng(6)
    pictures = {0: r.integers(60, 90, (9, 12)).astype(float), 1: np.full((8, 8), 50.0)}
    pictures[1][3, 4] = 58.0
    got = images(enhance.denoised(relation(spark, pictures), strength=9.0, template=3, search=5))
    for k, g in pictures.items():
        p, want = np.pad(g, 3, mode="reflect"), np.zeros_like(g)
        for y in range(g.shape[0]):
            for x in range(g.shape[1]):
                total = weight = 0.0
                for dy in range(-2, 3):
                    for dx in range(-2, 3):
                        a, b = p[y + 2 : y + 5, x + 2 : x + 5], p[y + dy + 2 : y + dy + 5, x + dx + 2 : x + dx + 5]
                        k_ = np.exp(-((a - b) ** 2).mean() / 81.0)
                        if k_ >= 0.001:
                            total, weight = total + k_ * p[y + dy + 3, x + dx + 3], weight + k_
                want[y, x] = total / weight
        assert np.allclose(got[k], want)
    both = images(enhance.basic_enhance(relation(spark, pictures), tiles=2, template=3, search=5))
    assert both[0].shape == (9, 12) and both[0].min() >= 0 and both[0].max() <= 255


# ---- sinks


def crops(spark, rows):
    return spark.createDataFrame(rows, "photo_id long, candidate_idx int, output_name string, content binary").repartition(3)


def test_crops_as_files(spark, tmp_path):
    (tmp_path / "out" / "taken.jpg").mkdir(parents=True)
    (tmp_path / "out" / "taken.jpg" / "x").write_bytes(b"1")
    rows = [(k, k % 2, f"A_Premium/p{k}.jpg", bytes([k] * 10)) for k in range(20)]
    bad = [(100, 0, "B_Good/" + "n" * 300, b"1"), (101, 0, "taken.jpg", b"2"), (102, 1, "C_Review/none.jpg", None)]
    path = f"file://{tmp_path}/out"
    failed = sinks.write_crops(crops(spark, rows + bad), path)
    assert sorted((r.photo_id, r.candidate_idx, r.output_name) for r in failed.collect()) == sorted(r[:3] for r in bad) and all(r.why for r in failed.collect())
    assert {p.name: p.read_bytes() for p in (tmp_path / "out" / "A_Premium").iterdir()} == {f"p{k}.jpg": bytes([k] * 10) for k in range(20)}
    assert not list((tmp_path / "out").glob("_tmp*")) and not list((tmp_path / "out" / "B_Good").iterdir())
    assert sinks.write_crops(crops(spark, rows), path).count() == 0  # again: the same files
    decided = spark.createDataFrame([(0, 0, "accept", "ok"), (100, 0, "accept", "ok"), (101, 0, "reject", "blurred")], "photo_id long, candidate_idx int, decision string, reason string")
    assert sorted(map(tuple, sinks.with_failures(decided, failed).collect())) == [(0, 0, "accept", "ok"), (100, 0, "reject", "write_failed"), (101, 0, "reject", "blurred")]


def test_an_aborted_write_leaves_no_part(tmp_path):
    from pyspark.sql import Row

    writer = sinks.CropWriter({"path": f"file://{tmp_path}", "job": "j"})

    def rows():
        yield Row(photo_id=1, candidate_idx=0, output_name="a/1.jpg", content=b"11")
        raise RuntimeError("the executor is lost")

    with pytest.raises(RuntimeError):
        writer.write(rows())
    writer.abort([None])
    assert [p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()] == ["a/1.jpg"] and not list(tmp_path.glob("_tmp*"))
    message = writer.write(iter([Row(photo_id=1, candidate_idx=0, output_name="a/1.jpg", content=b"22"), Row(photo_id=2, candidate_idx=0, output_name="a/2.jpg", content=None)]))
    assert message.files == 1 and message.failures
    writer.commit([message, None])
    said = [json.loads(line) for p in (tmp_path / "_failed" / "j").iterdir() for line in p.read_text().splitlines()]
    assert [(x["photo_id"], x["why"]) for x in said] == [("2", "no content")] and (tmp_path / "a" / "1.jpg").read_bytes() == b"22"


def test_report_is_one_file(spark, sf_dir, tmp_path):
    import csv
    import io

    s = config.merged({"whole_image_fallback": {"enabled": True}})
    decisions = D.decide(fixture.detections(spark, sf_dir).filter("photo_id < 60"), s)
    photos = fixture.photos(spark, sf_dir).filter("photo_id < 60").withColumns({"photo_sharpness": F.lit(120.0), "photo_fence": F.col("photo_id") % 2 == 0})
    whole = D.fallback(photos, decisions, s)
    errors = spark.createDataFrame([(-3, "reject", 'exception: a "b", c'), (61, "reject", "cv2_read_failed")], "photo_id long, decision string, reason string")
    header = sinks.write_report(decisions, f"file://{tmp_path}/r", s, whole, errors)
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "r").glob("part-*"))).decode("utf-8-sig")
    rows = list(csv.DictReader(io.StringIO(text, newline="")))
    assert text.startswith("image,decision,reason,candidate_idx,") and text.count("image,decision,reason") == 1 and list(rows[0]) == header
    assert (rows[0]["image"], rows[0]["reason"], rows[-1]["image"]) == ("-3", 'exception: a "b", c', "61") and [int(r["image"]) for r in rows] == sorted(int(r["image"]) for r in rows)
    assert len(rows) == decisions.count() + whole.count() + 2
    by = {(r["image"], r["candidate_idx"]): r for r in rows}
    kinds = set()
    for d in decisions.collect():
        r = by[str(d.photo_id), str(d.candidate_idx)]
        assert (r["decision"], r["reason"], r["is_full_frame"], float(r["confidence"])) == (d.decision, d.reason, str(d.full_frame), d.conf)
        assert r["quality_class"] == (d.quality_class or "") and (r["crop_x1"] != "") == (d.decision == "accept") == (r["output_path"] != "")
        kinds.add(d.reason)
    assert len(kinds) > 5
    kept = [r for r in rows if r["candidate_idx"] == "fallback"]
    assert {(r["decision"], r["reason"].split("_after_")[0], r["quality_score"]) for r in kept} == {("accept", "whole_image_fallback", "50.0"), ("reject", "fallback_fence", "")}
    assert report.header(report.report_rows(D.report_columns(decisions.limit(0), s))) == []


def test_manifest_settings_and_downloads(spark, sf_dir, tmp_path):
    decisions = D.decide(fixture.detections(spark, sf_dir), config.merged(None))
    sinks.write_manifest(decisions, f"{tmp_path}/m")
    back = spark.read.parquet(f"{tmp_path}/m")
    assert back.count() == decisions.filter("decision = 'accept'").count() and {r.quality_folder for r in back.select("quality_folder").distinct().collect()} == {"A_Premium", "B_Good"}
    (tmp_path / "s.json").write_text(json.dumps({"quality_scoring": {"premium_only": True}, "own": 1}))
    loaded = config.load(str(tmp_path / "s.json"))
    assert loaded["quality_scoring"]["premium_only"] and loaded["quality_scoring"]["classes"]["good"] == 60 and loaded["own"] == 1
    assert config.load(None) == config.load(str(tmp_path / "missing.json")) == config.merged(None)
    page, model = b"<!DOCTYPE html><html>" + b" " * 100, bytes(range(200))
    rows = spark.createDataFrame([("page", page), ("model", model), ("short", b"12"), ("null", None)], "name string, content binary")
    import hashlib

    right = {r.name: r.ok for r in rows.select("name", photo_files.is_valid_download(F.col("content"), 100, hashlib.sha256(model).hexdigest().upper()).alias("ok")).collect()}
    assert right["model"] is True and not right["page"] and not right["short"] and not right["null"]
    loose = {r.name: r.ok for r in rows.select("name", photo_files.is_valid_download(F.col("content"), 100).alias("ok")).collect()}
    assert (loose["model"], bool(loose["page"])) == (True, False)
