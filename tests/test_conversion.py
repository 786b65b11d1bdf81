"""Exact conversion of calls, texts of messages, benchmark rows, rescaling and identity, on hand-made cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import rescale as R
from lumenloom.functions import samples as S
from lumenloom.functions import text as T
from lumenloom.operators import conversations as C
from lumenloom.operators import datasets, identity, records, sampling, summary
from lumenloom.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


IMAGES = [(0, "initial", None, None, [200.0, 100.0]), (1, "region_crop", 0, [20.0, 10.0, 100.0, 60.0], [80.0, 50.0]), (2, "initial", 0, [0.0, 0.0, 1.0, 1.0], [9.0, 9.0]), (3, "region_crop", 7, [0.0, 0.0, 1.0, 1.0], [9.0, 9.0]), (4, "region_crop", 0, None, None), (5, "region_crop", 4, [0.0, 0.0, 1.0, 1.0], None)]
PLAIN = {"region_description": 'the "map"\n', "img_idx": 0}
FULL = {"name": "image_zoom_in_tool", "arguments": {"label": "ä", "img_idx": 0, "bbox_2d": [100.4, 99, 500, 601]}}


@pytest.mark.parametrize("call, presented, reason", [
    (PLAIN, [1], None), (FULL, [1], None), ({**FULL, "arguments": json.dumps(FULL["arguments"])}, [1], None), (None, [1], "not_an_object"), ([1], [1], "not_an_object"), ({**FULL, "name": "other"}, [1], "other_tool"),
    ({**FULL, "arguments": "{"}, [1], "unreadable_arguments"), ({**FULL, "arguments": "[]"}, [1], "arguments_not_an_object"), ({"name": "image_zoom_in_tool"}, [1], "arguments_not_an_object"),
    ({**FULL, "arguments": {**FULL["arguments"], "bbox_2d": [1, 2, 3]}}, [1], "inexact_arguments"), ({**FULL, "arguments": {**FULL["arguments"], "img_idx": "0"}}, [1], "inexact_arguments"),
    (PLAIN, [], "not_one_image"), (PLAIN, [1, 2], "not_one_image"), (PLAIN, None, "not_one_image"), (PLAIN, [9], "unknown_image"), (PLAIN, [2], "not_a_crop"), (PLAIN, [3], "other_parent"), (PLAIN, [4], "no_box"),
    ({**PLAIN, "img_idx": 7}, [3], "unknown_parent"), ({**PLAIN, "img_idx": 4}, [5], "no_parent_size"), ({**FULL, "arguments": {**FULL["arguments"], "bbox_2d": [103, 99, 500, 601]}}, [1], "box_differs"),
])
def test_exact_calls(spark, call, presented, reason):
    messages = [("user", "query", None, None), ("assistant", "tool_call", None if call is None else json.dumps(call), None), ("user", "tool_result", None, presented)]
    df = spark.createDataFrame([(messages, IMAGES)], f"m {C.CALLING}, s {C.SHOWN}")
    got = df.select(C.exact_calls(F.col("m"), F.col("s")).alias("c")).first().c
    assert got[0] is None and got[2] is None
    assert got[1].reason == reason
    if reason is None:
        label = call.get("region_description", "ä")
        assert got[1].arguments == json.dumps({"img_idx": 0, "label": label, "bbox_2d": [100, 100, 500, 600]}, ensure_ascii=False)
    else:
        assert got[1].arguments is None


def test_conversion_with_calls(spark):
    typed = [("user", "query", "q"), ("assistant", "tool_call", "<think>t</think>"), ("user", "tool_result", "<image>"), ("assistant", "answer", "a")]
    calling = lambda call: [("user", "query", None, None), ("assistant", "tool_call", json.dumps(call), None), ("user", "tool_result", None, [1]), ("assistant", "answer", None, None)]
    df = spark.createDataFrame([(1, typed, calling(PLAIN), IMAGES), (2, typed, calling({}), IMAGES)], f"id int, messages array<{C.MESSAGE}>, m {C.CALLING}, s {C.SHOWN}")
    got = {r.id: r for r in C.training_rows(df, calls=C.exact_calls(F.col("m"), F.col("s"), "label_first")).collect()}
    assert got[1].drop_reason is None and [k.arguments is not None for k in got[1].kept] == [False, True, False, False]
    assert list(json.loads(got[1].kept[1].arguments)) == ["label", "bbox_2d", "img_idx"]
    assert got[2].drop_reason == "other_tool" and got[2].kept is None


def test_texts(spark):
    think, answer, empty = F.lit("t"), F.lit("a"), F.lit("")
    assert one(spark, C.assistant_text(think, answer)) == "<think>t</think>\n<answer>a</answer>"
    assert [one(spark, C.assistant_text(t, a, False)) for t, a in ((think, answer), (empty, answer), (think, empty), (empty, empty))] == ["t\n\na", "a", "t", ""]
    assert [one(spark, C.assistant_text(t, None, tagged)) for t, tagged in ((think, True), (think, False), (F.lit(None).cast("string"), True))] == ["<think>t</think>", "t", ""]
    parts = F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(p, ("kind", "text", "label"))]) for p in (("text", "a", None), ("image_ref", None, "Image 1"), ("separator", "\n", None), ("text", " hint ", None), ("image_ref", None, None))])
    assert one(spark, C.parts_text(parts)) == "aImage 1:<image>\n hint <image>"
    assert one(spark, C.parts_text(parts, last_round_hint="hint")) == "aImage 1:<image>\n<image>"
    assert one(spark, C.parts_text(parts, keep_text=False)) == "Image 1:<image><image>"
    assert one(spark, C.parts_text(F.array(F.struct(F.lit("video").alias("kind"), F.lit("").alias("text"), F.lit("").alias("label"))))) is None


def test_benchmark_rows(spark):
    df = spark.createDataFrame([("q", "A\\nB", "A", 7, "x.jpg", "s", [[1.0, 2.0, 3.0, 4.0]], "c")], "question string, options string, answer string, question_id int, image string, subset string, boxes array<array<double>>, category string")
    r = datasets.benchmark_rows(df, "search", "v", "/data").first()
    assert (r.question, r.image, r.extra_info.question_id, r.extra_info.bboxes, r.extra_info.category) == ("q\nA\nB", "file:///data/x.jpg", "7", [[1, 2, 4, 6]], "c")
    assert datasets.benchmark_rows(df, "multiple_choice", "m").first().extra_info.subset == "s"
    collage = datasets.benchmark_rows(df.withColumn("index", F.lit(3)), "collage", "c").first()
    assert (collage.question, collage.extra_info.question_id, collage.extra_info.has_ref, collage.extra_info.qa_pairs) == ("q", "3", True, None)
    region = spark.createDataFrame([("the map", "4_1", [1, 2, 3, 4])], "region_description string, question_id string, bbox array<int>")
    r = datasets.benchmark_rows(region, "region", "r").first()
    assert (r.question, r.answer, r.extra_info.search_target, r.extra_info.bboxes) == ("the map", "[1, 2, 3, 4]", "the map", [[1, 2, 3, 4]])


def shown(w, h, f, most):
    a, b = max(1, round(w * f)), max(1, round(h * f))
    if 0 < most < a * b:
        ratio = math.sqrt(most / (a * b))
        a, b = max(1, int(a * ratio)), max(1, int(b * ratio))
    return a, b


@pytest.mark.parametrize("sizes, configured, least, budget, most", [([(1000, 700), (333, 901)], 0.35, 0, 500, 0), ([(1000, 700), (333, 901)], 0.1, 200_000, 120, 90_000), ([(64, 64)], 0.5, 10_000, 2, 0), ([], 0.5, 100, 10, 0), ([(50, 40)], 2.0, 1, 1, 0)])
def test_rescaling(spark, sizes, configured, least, budget, most):
    tokens = lambda f: sum(math.ceil(a / 32) * math.ceil(b / 32) for a, b in (shown(*s, f, most) for s in sizes))
    pixels = lambda f: sum(a * b for a, b in (shown(*s, f, most) for s in sizes))

    def search(lo, hi, keep_low):
        for _ in range(24):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if keep_low(mid) else (lo, mid)
        return lo, hi

    base = min(configured, 1.0)
    want = base if least <= 0 or not sizes or pixels(base) >= least else 1.0 if pixels(1.0) <= least else search(base, 1.0, lambda f: pixels(f) < least)[1]
    column = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in sizes]).cast("array<array<int>>")
    assert one(spark, R.dynamic_factor(column, F.lit(configured), F.lit(least), F.lit(most))) == pytest.approx(want, abs=1e-9)
    low, high = 0.1, 0.9
    fit = None if tokens(low) > budget else high if tokens(high) <= budget else search(low, high, lambda f: tokens(f) <= budget)[0]
    got = one(spark, R.largest_within_tokens(column, F.lit(budget), F.lit(low), F.lit(high), F.lit(most)))
    assert got == (None if fit is None else pytest.approx(fit, abs=1e-9))
    drawn = one(spark, R.randomised_factor(F.lit("k"), 3, column, F.lit(budget), F.lit(low), F.lit(high), F.lit(most)))
    assert (drawn.factor is None) == (fit is None or not sizes) and (drawn.factor is None or low <= drawn.factor <= min(high, fit))


def test_which_factor_holds(spark):
    sizes, nothing = F.array(F.array(F.lit(1000), F.lit(1000))), F.lit(None).cast("double")
    assert one(spark, R.sample_override(F.lit("0.5"))) == (0.5, True)
    assert [one(spark, R.sample_override(F.lit(v))).valid for v in ("", "0", "-1", "inf", "x")] == [True, False, False, False, False]
    drawn = F.struct(F.lit(0.3).alias("factor"), F.lit(0.31).alias("most"))
    got = one(spark, R.effective_factor(sizes, F.lit(0.2), nothing, drawn, F.lit(250_000), F.lit(0)))
    assert (got.actual, got.sampled, got.randomised, got.overridden) == (0.31, 0.3, True, False)
    got = one(spark, R.effective_factor(sizes, F.lit(0.2), F.lit(0.4), drawn, F.lit(0), F.lit(0)))
    assert (got.actual, got.randomised, got.overridden) == (0.4, False, True)
    got = one(spark, R.effective_factor(sizes, F.lit(1.5), nothing, drawn, F.lit(0), F.lit(0), F.lit(True)))
    assert (got.actual, got.randomised) == (1.5, False)
    got = one(spark, R.fitted_prompt(sizes, F.lit(10), F.lit(300), F.lit(0)))
    assert (got.steps, got.fits) == (2, True) and one(spark, R.fitted_prompt(sizes, F.lit(10), F.lit(5), F.lit(0))).steps == 4
    assert one(spark, R.presented_size_unless_one(F.array(F.lit(7), F.lit(5)), F.lit(1.0), F.lit(0))) == [7, 5]


def test_identity(spark):
    config = {"b": [1, {"ä": None}], "ray_vllm": {"gpu_memory_utilization": 0.9, "model": "m"}, "a": 1.5}
    assert one(spark, identity.canonical_json(F.lit(json.dumps(config)))) == json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert one(spark, identity.canonical_json(F.lit("{"))) is None
    other = {**config, "ray_vllm": {"model": "m", "gpu_memory_utilization": 0.5}}
    assert one(spark, identity.config_hash(F.lit(json.dumps(config)))) == one(spark, identity.config_hash(F.lit(json.dumps(other))))
    assert one(spark, identity.config_hash(F.lit(json.dumps(config)))) != one(spark, identity.config_hash(F.lit("{}")))
    old = {"model": "m", "num_trials": 2, "val_files": ["a"], "max_samples": -1}
    assert identity.may_resume(old, {**old, "num_trials": 3, "val_files": ["b", "a"]})[0]
    for bad in ({"model": "n"}, {"num_trials": 1}, {"val_files": []}):
        assert not identity.may_resume(old, {**old, **bad})[0]
    assert not identity.may_resume({**old, "max_samples": 5}, {**old, "max_samples": 5, "val_files": ["a", "b"]})[0]
    assert one(spark, identity.prompt_signature(F.lit("a"), F.lit(None))) != one(spark, identity.prompt_signature(F.lit("a"), F.lit("")))


def test_unscored_failures_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([("s", None, True, ["a\nb", "c"]), (None, None, True, None), ("", None, True, []), ("s", 1.0, True, ["a"]), ("s", None, False, ["a"])], "data_source string, score double, critical_failure boolean, failure_reasons array<string>")
    got = [tuple(r) for r in summary.unscored_failures(df).collect()]
    assert got == [("s", "a", 1), ("s", "c", 1), ("unknown", "critical_failure", 2)]
    assert sinks.write_bundle({"t": df.withColumn("score", F.lit(float("nan")))}, str(tmp_path / "b")) == {"t": 5}
    assert json.loads((tmp_path / "b" / "t.json").read_text())[0]["score"] is None
    assert (tmp_path / "b" / "t.tsv").read_text().splitlines()[0] == "data_source\tscore\tcritical_failure\tfailure_reasons"


def test_labels_go_to_the_next_image(spark):
    parts = [("text", "look\n", None), ("text", " Image 3: ", None), ("image_url", None, "high"), ("text", "\n---\n", None), ("image_url", None, None), ("video", "x", None), ("text", "last round", None), ("text", "Image 4:", None)]
    df = spark.createDataFrame([(parts,), ([("text", "a", None)],), ([],)], "p array<struct<type:string,text:string,detail:string>>")
    rows = df.select(C.labelled_parts(F.col("p")).alias("p"))
    got = rows.collect()
    assert [(x.kind, x.text, x.label, x.presented_img_idx, x.detail) for x in got[0].p] == [
        ("text", "look\n", None, None, None), ("image_ref", None, "Image 3", 3, "high"), ("separator", "\n---\n", None, None, None), ("image_ref", None, None, None, None), ("text", "last round", None, None, None),
    ]
    told = [r.r for r in rows.select(C.recovered_result(F.col("p"), " last round ").alias("r")).collect()]
    assert (told[0].hint, told[0].presented, told[0].secondary) == ("look", [3], ["last_round_hint"]) and told[1:] == [None, None]


def test_small_texts_and_times(spark):
    assert [one(spark, T.slug(F.lit(v))) for v in ("a/b c.d", "-x#%y-", "0.25")] == ["a_b_c_d", "x_y", "0_25"]
    lists = ["['a', 1, None]", "[1, 2", "3, 4 x", "", None, '["b"]']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v string")
    got = [r.l for r in df.orderBy("i").select(T.literal_list(F.col("v")).alias("l")).collect()]
    assert got == [["a", "1", None], ["[1", "2"], ["3", "4", "x"], [], [], ["b"]]
    assert one(spark, T.whole_numbers(F.array(*[F.lit(v) for v in ("1", " 2 ", "x", "3.5", "-4")]))) == [1, 2, -4]
    assert [one(spark, T.first_reasons(F.array(*map(F.lit, v)).cast("array<string>"))) for v in (list("abcde"), ["a"], [])] == ["a; b; c; ... (5 reasons total)", "a", None]
    assert [one(spark, S.core_time(F.lit(a).cast("double"), F.lit(None).cast("double"), F.lit(2.0))) for a in (1.5, None)] == [3.5, None]
    assert [(p.type, p.text) for p in one(spark, records.pruned_content(F.array(records._part("text", F.lit("a")), records._part("image_url", url=F.lit("u")))))] == [("text", "a"), ("image_url", "[pruned]")]


def test_shuffling_and_reconciling(spark):
    order = [r.id for r in sampling.shuffled(spark.range(50), "id", 1).collect()]
    assert sorted(order) == list(range(50)) and order == [r.id for r in sampling.shuffled(spark.range(50).repartition(5), "id", 1).collect()] != list(range(50))
    want = spark.createDataFrame([("a", 2), ("b", 1), ("c", None), (None, 1)], "source string, expected int")
    have = spark.createDataFrame([("a",), ("a",), ("d",), (None,)], "source string")
    assert {tuple(r) for r in datasets.reconciled(want, have).collect()} == {("a", 2, 2, True), ("b", 1, 0, False), ("c", None, 0, None), (None, 1, 1, True), ("d", None, 1, None)}
