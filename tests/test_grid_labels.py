import pytest

import __spark_entry__ as entry
from fieldchirp.operators import annotations as ann
from fieldchirp.operators import clips

SMALL = "/root/testdata/sf0.001"
GRIDS = [
    (5.0, {}), (5.0, {"final_clip": "remainder"}), (5.0, {"final_clip": None}), (5.0, {"final_clip": "full"}), (0.3, {"clip_overlap": 0.1}), (0.7, {"clip_step": 1.9, "final_clip": "remainder"}), (2.0, {"overlap_fraction": 0.75, "digits": 1}),
]


def tables(spark):
    files = [("a", 23.0), ("b", 0.4), ("c", 400.0), ("d", None), ("e", 12.3), (None, 9.0)]
    boxes = [("a", "x", 4.9, 5.1), ("a", "x", 5.0, 10.0), ("a", "y", 22.0, 99.0), ("a", "x", -3.0, 0.2), ("b", "y", 0.1, 0.3), ("c", "z", 1.0, 399.0), ("c", "x", 0.3, 0.6), ("c", "x", 311.1, 311.4)]
    boxes += [("c", "y", 500.0, 501.0), ("c", None, 1.0, 2.0), ("e", "x", 2.0, 2.0), ("e", "y", 11.0, 12.2), ("e", "y", 10.0, 12.2), ("f", "x", 0.0, 9.0), (None, "x", 0.0, 9.0), ("e", "x", None, 3.0), ("e", "x", 1.0, float("nan"))]
    table = spark.createDataFrame(boxes, "audio_file string, annotation string, start_time double, end_time double")
    return spark.createDataFrame(files, "file string, duration double"), ann.annotation_table(table)


def rows(df):
    return sorted(map(repr, df.collect()))


def plan_after_run(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("clip, grid", GRIDS)
def test_matches_of_a_grid_are_those_of_its_clips(spark, clip, grid):
    files, boxes = tables(spark)
    for least, part in ((0.05, None), (0.2, 0.5)):
        want = rows(ann.clip_matches(clips.clip_grid(files, clip, **grid), boxes, least, part))
        assert want and rows(ann.grid_matches(files, boxes, clip, least, part, **grid)) == want


def test_interval_join_broadcasts_nothing(spark):
    files, boxes = tables(spark)
    assert "Broadcast" not in plan_after_run(ann.clip_matches(clips.clip_grid(files, 5.0), boxes, 0.2))
    assert "Broadcast" not in plan_after_run(entry.queries()["interval_join_overlap"](spark, SMALL))


@pytest.mark.parametrize("clip, grid", GRIDS)
def test_label_lists_of_a_grid_are_those_of_its_clips(spark, clip, grid):
    files, boxes = tables(spark)
    for kw in ({"integers": True}, {"keep_duplicates": True, "min_fraction": 0.5}):
        want = rows(ann.label_lists_on_clips(clips.clip_grid(files, clip, **grid), boxes, ["y", "x"], 0.05, **kw))
        assert rows(ann.clip_label_lists(files, boxes, ["y", "x"], clip, 0.05, **kw, **grid)) == want


def test_label_lists_broadcast_nothing(spark):
    files, boxes = tables(spark)
    assert "Broadcast" not in plan_after_run(ann.label_lists_on_clips(clips.clip_grid(files, 5.0), boxes, ["x"], 0.2))
    assert "Broadcast" not in plan_after_run(entry.queries()["labels_keep_duplicates"](spark, SMALL))


@pytest.mark.parametrize("clip, grid", GRIDS)
def test_hot_labels_of_a_grid_are_those_of_its_clips(spark, clip, grid):
    files, boxes = tables(spark)
    for least, part in ((0.05, None), (0.2, 0.5)):
        want = rows(ann.labels_on_clips(clips.clip_grid(files, clip, **grid), boxes, ["y", "x"], least, part))
        assert rows(ann.clip_labels(files, boxes, ["y", "x"], clip, least, part, **grid)) == want


def test_hot_labels_of_fractions_broadcast_nothing(spark):
    files, boxes = tables(spark)
    assert "Broadcast" not in plan_after_run(ann.labels_on_clips(clips.clip_grid(files, 5.0), boxes, ["x"], 0.2))
    assert "Broadcast" not in plan_after_run(entry.queries()["labels_multihot_fraction"](spark, SMALL))


def test_integer_lists_broadcast_nothing(spark):
    assert "Broadcast" not in plan_after_run(entry.queries()["labels_integer_lists"](spark, SMALL))


def test_multihot_broadcasts_nothing(spark):
    assert "Broadcast" not in plan_after_run(entry.queries()["labels_multihot"](spark, SMALL))
