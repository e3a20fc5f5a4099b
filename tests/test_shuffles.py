"""What plans shuffle and broadcast: queries that grow with a table move each row once, in its narrow form."""

import re

import pytest

import __spark_entry__
from sightline.operators import fences
from sightline.plans import photo_queries

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange (?:hash|range)partitioning.*", plan(df))


@pytest.fixture(scope="module")
def made():
    return __spark_entry__.queries()


def test_equalised_broadcasts_nothing(spark, made):
    """Tables of levels have 4,096 rows a picture, which the size of their files doesn't tell: broadcasts of them ended the driver."""
    df = made["equalised"](spark, SMALL)
    assert "Broadcast" not in plan(df) and all("REPARTITION_BY_NUM" in x for x in shuffles(df)) and shuffles(df)


def test_denoised_shuffles_pictures_not_pixels(spark, made):
    df = made["denoised"](spark, SMALL)
    assert len(shuffles(df)) == 1 and "REPARTITION_BY_NUM" in shuffles(df)[0] and "Join" not in plan(df)


def test_resampled_broadcasts_its_weights(spark, made):
    """Pixels shuffled by size went to as many tasks as there are rows of a picture."""
    found = shuffles(made["resampled_larger"](spark, SMALL))
    assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0]


def test_fences_do_not_shuffle_pixels(spark):
    pixels = photo_queries._pictures(spark, SMALL)
    found = shuffles(fences.opened_runs(pixels, photo_queries.FENCE))
    assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0]


@pytest.mark.parametrize("name", ["quality_score", "decisions_fast", "decisions_slow", "decisions_strict_guard", "manifest_names", "post_processing", "score_components"])
def test_detections_are_shuffled_once(spark, made, name):
    """The number of a candidate and the photo's other detections are windows over one shuffle of the source's columns."""
    assert len(shuffles(made[name](spark, SMALL))) == 1


@pytest.mark.parametrize("name", ["tally", "fallback"])
def test_what_groups_decisions_by_photo_shuffles_no_more(spark, made, name):
    """One shuffle of detections, one of photos."""
    assert len(shuffles(made[name](spark, SMALL))) == 2


def test_the_report_is_sorted_by_its_one_shuffle(spark, made):
    df = made["report"](spark, SMALL)
    found = shuffles(df)
    assert len(found) == 1 and "rangepartitioning" in found[0]
    keys = [(r.photo_id, r.candidate_idx) for r in df.select("photo_id", "candidate_idx").collect()]
    assert keys == sorted(keys) and keys


def test_staged_rows_are_written_without_keypoints(spark, made, monkeypatch):
    from sightline.operators import staged

    wrote = []
    monkeypatch.setattr(staged, "settled", lambda df: wrote.append(df.columns) or df.localCheckpoint())
    made["decisions_staged"](spark, SMALL)
    assert wrote and not {"kps", "dets"} & set(wrote[0])


def test_the_report_file_writes_decisions_without_keypoints(spark, made, monkeypatch):
    wrote, write = [], photo_queries.settled
    monkeypatch.setattr(photo_queries, "settled", lambda df: wrote.append(df.columns) or write(df))
    assert made["report_file"](spark, SMALL).count() and not any({"kps", "dets"} & set(columns) for columns in wrote)


def carrying(df, name):
    """Kinds of the optimized plan's operators that give rows with a column."""
    found, left = [], [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        if name in [node.output().apply(i).name() for i in range(node.output().size())]:
            found.append(node.nodeName())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("name", ["decisions_fast", "decisions_slow", "manifest_names", "flagship_reason_class", "counters", "quality_score", "tally", "report"])
def test_keypoints_are_made_after_the_windows_and_read_at_once(spark, made, name):
    """They were copied through two windows, a generator and a dozen projections."""
    assert carrying(made[name](spark, SMALL), "kps") == ["Project"]
    assert "Generate" not in carrying(made[name](spark, SMALL), "dets")
