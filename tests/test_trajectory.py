"""The trajectory audit on hand-made conversations."""

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import trajectory as T

SCHEMA = f"conv int, difficulty string, subset string, source string, is_unanswerable boolean, tool_calls int, tool_limit int, crops {T.CROPS}, evidence {T.EVIDENCE}, sizes {T.SIZES}"
B = [0.0, 0.0, 10.0, 10.0]


def measured(spark, crops, evidence, sizes, calls=2, limit=2):
    df = spark.createDataFrame([(1, "e", None, "s", None, calls, limit, crops, evidence, sizes)], SCHEMA)
    return T.trajectory_rows(df).first()


def test_nothing_at_all(spark):
    r = measured(spark, None, None, None, 0, None)
    assert (r.num_crops, r.has_evidence, r.crop_hits_evidence_page, r.max_crop_evidence_iou) == (0, False, None, None)
    assert (r.zoom_area_fraction_union, r.zoom_area_fraction_sum, r.mean_crop_area_fraction_of_page, r.num_zoomed_source_pages) == (0.0, 0.0, None, 0)
    assert (r.last_same_page_crop_run_length, r.last_crop_page_id, r.exhausted_tool_call_limit, r.stuck_exhausted_same_page_tail) == (0, None, None, None)
    assert (r.same_source_img_crop_pairs, r.max_crop_pair_iou, r.first_any_evidence_page_hit_step) == (0, None, None)


def test_evidence_without_crops_counts_as_zero(spark):
    r = measured(spark, [], [(3, B, True), (4, None, False)], {})
    assert (r.max_crop_evidence_iou, r.max_evidence_coverage, r.max_crop_precision_vs_evidence) == (0.0, 0.0, 0.0)
    assert (r.crop_covers_evidence_at_threshold, r.crop_hits_evidence_page, r.num_scaled_evidence_boxes) == (False, False, 1)
    assert (r.num_evidence_pages, r.num_evidence_boxes, r.num_evidence_box_pages, r.fraction_cropped_evidence_box_pages_covered) == (2, 1, 1, None)


def test_pages_without_boxes_hit_but_cover_nothing(spark):
    r = measured(spark, [(7, 4, B)], [(4, None, None)], {})
    assert (r.crop_hits_evidence_page, r.max_evidence_coverage, r.crop_covers_evidence_at_threshold, r.first_any_evidence_page_hit_step) == (True, None, None, 1)
    assert r.num_crops_on_evidence_box_pages == 0


def test_steps_runs_and_pairs(spark):
    crops = [(5, 5, B), (1, 1, B), (2, 2, [0.0, 0.0, 5.0, 10.0]), (2, 2, B)]
    r = measured(spark, crops, [(1, B, False), (2, B, False)], {1: [10.0, 20.0], 2: [20.0, 20.0]})
    assert (r.first_any_evidence_page_hit_step, r.first_all_evidence_pages_hit_step, r.first_evidence_region_coverage_hit_step) == (2, 3, 2)
    assert (r.extra_crops_after_first_any_evidence_page_hit, r.stopped_at_first_all_evidence_pages_hit) == (2, False)
    assert (r.last_same_page_crop_run_length, r.last_crop_page_id, r.stuck_exhausted_same_page_tail) == (2, 2, True)
    assert (r.same_source_img_crop_pairs, r.redundant_crop_pairs, r.max_crop_pair_iou) == (1, 0, 0.5)
    assert (r.num_cropped_evidence_box_pages, r.num_cropped_evidence_box_pages_covered, r.num_crops_hit_evidence_region_at_threshold) == (2, 2, 3)
    assert r.zoom_area_fraction_union == pytest.approx(200 / 600) and r.zoom_area_fraction_sum == pytest.approx(250 / 600)
    assert r.mean_crop_area_fraction_of_page == pytest.approx((0.5 + 0.125 + 0.25) / 3) and r.max_crop_area_fraction_of_page == pytest.approx(0.5)
    assert (r.num_zoomed_source_pages, r.num_crops_missing_page_size, r.max_crop_precision_vs_evidence) == (2, 1, 1.0)


def test_crops_without_known_pages(spark):
    r = measured(spark, [(1, 1, B), (1, 1, B)], [], {1: [0.0, 5.0]})
    assert (r.zoom_area_fraction_union, r.zoom_area_fraction_sum, r.num_crops_missing_page_size, r.redundant_crop_pairs) == (None, None, 2, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*values, kind="int"):
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def test_evidence_boxes_are_scaled_once(spark):
    box = lambda *v: arr(*map(float, v), kind="double")
    got = one(spark, T.scaled_evidence(box(61.2, 79.2, 122.4, 158.4), box(1224, 1584)))
    assert got.scaled and got.box == pytest.approx([122.4, 158.4, 244.8, 316.8])
    assert not one(spark, T.scaled_evidence(box(0, 0, 951, 10), box(1224, 1584))).scaled
    assert one(spark, T.scaled_evidence(box(0, 0, 950, 10), box(1224, 1584))).scaled
    got = one(spark, T.scaled_evidence(box(1, 2, 3, 4), F.lit(None).cast("array<double>")))
    assert (got.box, got.scaled) == ([1, 2, 3, 4], False)


def test_page_maps(spark):
    rows = [([(4, "file:///d/000007.jpg", [10.0, 20.0]), (None, "x/cover.png", [0.0, 5.0]), (4, "d/9.jpg", [3.0, 4.0]), (None, None, [5.0])],), ([],), (None,)]
    df = spark.createDataFrame(rows, "i array<struct<original_img_idx:int,path:string,original_size:array<double>>>")
    pages, sizes = T.page_of_input(F.col("i"))
    got = df.select(pages.alias("p"), sizes.alias("s")).collect()
    assert got[0].p == {4: 9, 1: 1, 3: 3} and got[0].s == {7: [10, 20], 9: [3, 4]}
    assert [tuple(r) for r in got[1:]] == [({}, {}), ({}, {})]


@pytest.mark.parametrize("source, pages, boxes, want", [("dude", [1, 3], [], [0, 2]), ("dude", [0, 3], [], [0, 3]), ("DUDE", [1, 9], [2], [1]), ("mpdocvqa", [1, 5, 6, 1], [], [0, 4])])
def test_asked_pages(spark, source, pages, boxes, want):
    assert one(spark, T.asked_pages(arr(*pages), F.lit(5), F.lit(source), arr(*boxes))) == want


@pytest.mark.parametrize("source, field, pages, start, want", [("longdocurl", "evidence_pages", [12], 10, [2]), ("longdocurl", "question_page_num", [12], 10, [12]), ("mmlongbench", "evidence_pages", [1, 0], None, [0]), ("dude", "question_page_num", [1, 3], None, [0, 2]), ("dude", "question_page_num", [0, 3], None, [0, 30])])
def test_input_pages(spark, source, field, pages, start, want):
    stems = F.create_map(F.lit(3), F.lit(30))
    assert one(spark, T.input_pages(arr(*pages), F.lit(source), field, F.lit(start).cast("int"), stems)) == want


def test_summaries_of_no_rows_and_null_levels(spark):
    df = spark.createDataFrame([(1, "e", None, "s", True, 0, None, [], [], {}), (2, "e", "x", "s", None, 3, 2, [(1, 1, B)], [(1, B, True)], {1: [10.0, 10.0]})], SCHEMA)
    got = {(r.level, r.difficulty, r.subset): r for r in T.training_summary(T.trajectory_rows(df)).collect()}
    every = got[(7, None, None)]
    assert (every.rows, every.answerable_rows, every.rows_with_evidence, every.evidence_page_hit_rate, every.median_crops) == (2, 1, 1, 1.0, 0.5)
    assert (every.total_crops_per_evidence_region_hit_crop, every.mean_zoom_area_fraction_union, every.tool_call_limit_exhaustion_rate) == (1.0, 0.5, 1.0)
    assert got[(5, None, None)].rows == 1 and got[(5, None, "x")].rows == 1
    assert {r.rows for r in T.training_summary(T.trajectory_rows(df.limit(0))).collect()} <= {0}
