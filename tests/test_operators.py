"""Functions and operators on small hand-made cases."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenloom.functions import geometry as G
from lumenloom.functions import text as T
from lumenloom.functions import values as V
from lumenloom.operators import audit, conversations, datasets, logs, sampling, summary


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_geometry(spark):
    a, b = box(0, 0, 2, 2), box(1, 1, 3, 3)
    assert one(spark, G.iou(a, b)) == pytest.approx(1 / 7)
    assert one(spark, G.union_area(F.array(a, b))) == 7
    assert one(spark, G.union_area(F.array().cast("array<array<double>>"))) == 0
    assert one(spark, G.iou(box(1, 1, 1, 1), box(1, 1, 1, 1))) == 0
    assert one(spark, G.area(box(3, 3, 1, 5))) == 0
    assert one(spark, G.clamp(box(-5, 1, 50, 9), F.lit(10.0), F.lit(10.0))) == [0, 1, 10, 9]
    assert one(spark, G.clamp(box(11, 1, 50, 9), F.lit(10.0), F.lit(10.0))) is None
    assert one(spark, G.resize(F.lit(5), F.lit(5), F.lit(0.5))) == [2, 2]
    assert one(spark, G.cap_area(F.lit(100), F.lit(100), F.lit(2500))) == [50, 50]
    assert one(spark, G.overlap(F.lit(None).cast("array<double>"), a)) is None
    assert one(spark, G.aspect_ratio(F.lit(0), F.lit(5))) == math.inf
    assert one(spark, G.image_tokens(F.array(F.array(F.lit(33), F.lit(32))))) == 2
    assert one(spark, G.within_tolerance(a, box(1, 0, 2, 2)))
    assert one(spark, G.largest_factor(lambda f: f <= 0.5)) == pytest.approx(0.5)
    assert one(spark, G.to_thousandths(box(5, 0, 20, 10), F.lit(10.0), F.lit(10.0))) == [500, 0, 1000, 1000]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 12)] * 4), min_size=1, max_size=5))
def test_union_area_counts_cells(spark, raw):
    cells = {(x, y) for x1, y1, x2, y2 in raw for x in range(x1, x2) for y in range(y1, y2)}
    got = one(spark, G.union_area(F.array(*[box(*b) for b in raw])))
    assert got == len(cells)


def test_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert df.select(V.mean(F.col("x")), V.deviation(F.col("x"))).first()[:] == (1.0, 0.0)
    assert df.where("x is null").select(V.deviation(F.col("x")).alias("d")).first().d is None
    nums = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    assert nums.select(V.quantile(F.col("x"), 0.9).alias("q")).first().q == pytest.approx(3.7)
    assert one(spark, V.finite_float(F.lit("inf"))) is None
    assert one(spark, V.optional_text(F.lit(" None "))) is None
    import hashlib

    key = json.dumps({"resume_file_row_idx": 7, "resume_val_file": "ä/v.parquet", "trial_idx": 0}, sort_keys=True, ensure_ascii=False)
    assert one(spark, V.job_key(F.lit(0), F.lit("ä/v.parquet"), F.lit(7))) == hashlib.sha256(key.encode()).hexdigest()


@pytest.mark.parametrize("reason, kind", [
    ("TimeoutError: 429", "timeout"), ("429 busy", "rate_limit"), ("Prompt is too long", "context_overflow"), ("  ", "unknown_failure"),
    ("empty assistant turn", "empty_assistant_message"), ("judge_error: x: y", "judge_error"), ("a : : b: c", "a:b"), ("x" * 200, "x" * 96),
])
def test_failure_kind(spark, reason, kind):
    assert one(spark, T.failure_kind(F.lit(reason))) == kind


def test_text(spark):
    assert [one(spark, T.rescale_tag(F.lit(v))) for v in ("0.25", "0.50", ".5", "1.0")] == ["025", "05", "05", "1"]
    assert one(spark, T.truncate(F.lit("abcdefgh"), 4)) == "ab...(truncated)...gh"
    assert one(spark, T.longest_run(F.split(F.lit("a b b b a"), " "))) == 3
    assert one(spark, T.repeated_ngrams(F.split(F.lit("a b a b a b"), " "), 2)) == 3
    assert one(spark, T.degenerate_reasons(F.lit("x " * 12))) == ["repeated_word"]
    assert one(spark, T.degenerate_reasons(F.lit(None).cast("string"))) == []
    assert one(spark, T.page_numbers(F.lit("[1, 2] 3x 4"))) == [1, 2, 4]
    assert one(spark, T.boxes_in_text(F.lit("a <box>(1,2, 3,4)</box> <box>(1)</box>"))) == [[1, 2, 3, 4]]
    assert [c.name for c in one(spark, T.tool_calls(F.lit('<tool_call>{"name":"z","arguments":{"a":1}}</tool_call><tool_call>{</tool_call>')))] == ["z"]
    assert one(spark, T.benchmark(F.lit(None).cast("string"), F.lit("/a/dude-val-1.json"))) == "dude"
    calls = one(spark, T.channel_tool_calls(F.lit('<|start|>assistant<|channel|>analysis<|message|>to=functions.no<|end|><|start|>assistant<|channel|>commentary to=functions.zoom <|constrain|>json<|message|>{"a":1}<|call|>')))
    assert [(c.name, c.arguments) for c in calls] == [("zoom", '{"a":1}')]
    assert [(p.kind, p.text) for p in one(spark, T.content_parts(F.lit("<image><image>a<image>")))] == [("image", ""), ("image", ""), ("text", "a"), ("image", "")]
    assert one(spark, T.unanswerable_text(F.lit("Not Answerable"))) and not one(spark, T.unanswerable_text(F.lit("not answerable"), needles=T.UNANSWERABLE_RECORD))
    assert not one(spark, T.unanswerable_text(F.lit(None).cast("string")))
    assert one(spark, T.truncate(F.lit("abc"), 0)) == "abc"
    assert one(spark, T.page_of_path(F.lit("doc/000012.jpg"))) == 12
    assert one(spark, T.rewrite_prefix(F.lit("/a/bc/x"), {"/a/b": "/n", "/a": "/m"})) == "/m/bc/x"
    assert one(spark, T.category(F.lit("map_metro_answerable_mc_false_e"))) == "map_metro"
    assert one(spark, T.answerability(F.lit("x_unanswerable"))) == "unanswerable"


def test_latest_wins_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 1, "x"), ("a", 1.0, 2, "y"), ("b", None, 3, "z"), ("b", 0.5, 1, "w"), (None, 1.0, 9, "n")], "k string, t double, r int, v string")
    assert {(r.k, r.v) for r in logs.latest_wins(df, ["k"], ["t", "r"]).collect()} == {("a", "y"), ("b", "w")}


def test_merge_judged(spark):
    left = spark.createDataFrame([(1, "l", None), (2, "l", None)], "k int, v string, score double")
    right = spark.createDataFrame([(2, "r", 0.5), (3, "r", 1.0)], "k int, v string, score double")
    assert {tuple(r) for r in logs.merge_judged(left, right, "k").collect()} == {(1, "l", None, True), (2, "l", 0.5, False), (3, "r", 1.0, False)}
    assert {tuple(r)[:3] for r in logs.merge_judged(left, right, "k", rescore=True).collect()} == {(1, "l", None), (2, "l", None), (3, "r", 1.0)}


def test_sweep_keeps_empty_trials(spark):
    df = spark.createDataFrame([(0, 1, 1.0, False, 2.0), (2, 1, None, True, 4.0)], "trial_idx int, sample_index bigint, score double, critical_failure boolean, wall_time_s double")
    got = {r.trial_idx: r for r in summary.sweep_per_trial(df, trials=3, expected=2).collect()}
    assert (got[1].n_exported, got[1].n_missing, got[1].accuracy_valid) == (0, 2, None)
    assert (got[0].accuracy_valid, got[0].accuracy_expected, got[2].n_valid) == (1.0, 0.5, 0)


def test_sweep_rejects_failed_samples(spark):
    df = spark.createDataFrame([(0, 1, 1.0, False, ["tool error"], 2.0), (0, 2, 1.0, False, [""], 2.0), (0, 3, 1.0, True, None, 2.0), (2, 1, 0.0, None, [], 4.0)],
                               "trial_idx int, sample_index bigint, score double, critical_failure boolean, failure_reasons array<string>, wall_time_s double")
    per = summary.sweep_per_trial(df)
    got = {r.trial_idx: r for r in per.collect()}
    assert (got[0].n_valid, got[0].n_expected, got[0].accuracy_valid, got[0].accuracy_expected) == (1, 3, 1.0, 1 / 3)
    assert (got[1].n_exported, got[1].n_missing, got[2].n_missing, got[2].n_fail_or_missing) == (0, 3, 2, 2)
    assert {r.kind: r.n for r in summary.sweep_failures(df, per).collect()} == {"missing_sample": 5, "tool error": 1, "critical_failure": 1}
    assert summary.sweep_per_trial(df.limit(0)).count() == 0


def test_critical_failures_are_run_again(spark):
    had = spark.createDataFrame([("a", [], True), ("b", None, False), ("c", ["x"], False), ("d", [None], None)], "job_key string, failure_reasons array<string>, critical_failure boolean")
    jobs = spark.createDataFrame([(k,) for k in "abcde"], "job_key string")
    assert {r.job_key: r.state for r in logs.classify_jobs(jobs, had).collect()} == {"a": "failed", "b": "reused", "c": "failed", "d": "reused", "e": "missing"}
    told = spark.createDataFrame([("a", [], {"error_type": "E"}), ("b", [], {"score": "1"})], "job_key string, failure_reasons array<string>, score map<string,string>")
    assert {r.job_key: r.state for r in logs.classify_jobs(jobs.limit(2), told).collect()} == {"a": "failed", "b": "reused"}
    was = spark.createDataFrame([("f", 5), ("g", 2), ("h", 1)], "item string, n int")
    now = spark.createDataFrame([("f", 6), ("g", 1), ("i", 1)], "item string, n int")
    assert {(r.item, r.change) for r in logs.identity_changes(was, now).collect()} == {("g", "shrunk"), ("h", "removed")}


def test_histogram(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (9,)], "n int")
    assert summary.histogram(df, "n", 5).first()[:] == (1, 1, 0, 0, 0, 2)


def crops(spark, rows):
    return spark.createDataFrame(rows, "conv int, step bigint, page int, box array<double>")


def test_audit(spark):
    b = [0.0, 0.0, 10.0, 10.0]
    seen = crops(spark, [(1, 1, 5, b), (1, 2, 1, b), (1, 3, 2, b), (1, 4, 2, b)])
    run = audit.tail_run(seen).first()
    assert (run.n_crops, run.last_page, run.run_length) == (4, 2, 2)
    evidence = spark.createDataFrame([(1, 1, b), (1, 2, b), (7, 1, b)], "conv int, page int, box array<double>")
    hits = {r.conv: r for r in audit.first_hits(seen, evidence, 0.5).collect()}
    assert (hits[1].any_step, hits[1].all_step, hits[1].cover_step, hits[1].extra_after_any) == (2, 3, 2, 2)
    assert (hits[7].any_step, hits[7].all_step, hits[7].cover_step, hits[7].extra_after_any) == (None, None, None, None)
    assert audit.redundancy(seen, 0.5).first().redundant == 1
    stuck = audit.stuck(audit.tail_run(seen).withColumn("limit", F.lit(None).cast("int")), "limit").first()
    assert stuck.stuck is None


def fold(spark, kinds):
    roles = {"a": ("assistant", "answer"), "r": ("assistant", "answer_revision"), "h": ("user", "answer_verification_hint"), "c": ("assistant", "tool_call"), "t": ("user", "tool_result"),
             "f": ("user", "tool_result_fail_hint"), "o": ("assistant", "others"), "p": ("user", "format_repair_hint"), "s": ("system", "system_prompt"), "q": ("user", "query"), "l": ("user", "last_round_hint")}
    rows = [(*roles[k.lower()], "" if k.isupper() else f"{k}{i}") for i, k in enumerate(kinds)]
    df = spark.createDataFrame([(rows,)], f"messages array<{conversations.MESSAGE}>")
    got = conversations.training_rows(df).first()
    return got.drop_reason, None if got.kept is None else [(m.text, m.loss) for m in got.kept]


@pytest.mark.parametrize("kinds, reason, kept", [
    ("ahaha", None, ["a2", "h3", "a4"]), ("sqa", None, ["s0", "q1", "a2"]), ("qct", None, ["q0", "c1", "t2"]), ("qc", "tool_call_without_result", None),
    ("qcf", "tool_call_without_result", None), ("qA", "empty_answer", None), ("qopa", None, ["q0", "a3"]), ("qo", "unsupported_assistant_message", None),
    ("qahr", None, ["q0", "r3"]), ("qla", None, ["q0", "a2"]), ("qf", "failed_tool_result", None), ("qahRa", "empty_answer", None),
])
def test_conversion_rules(spark, kinds, reason, kept):
    got_reason, got = fold(spark, kinds)
    assert got_reason == reason
    assert (None if got is None else [t for t, _ in got]) == kept


def test_conversion_of_nothing(spark):
    df = spark.createDataFrame([([],), (None,)], f"messages array<{conversations.MESSAGE}>")
    assert [r.drop_reason for r in conversations.training_rows(df).collect()] == ["empty", "empty"]


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    assert {r.k for r in sampling.sample(df, "k", 10).collect()} == {r.k for r in sampling.sample(df.repartition(7), "k", 10).collect()}
    part = sampling.split(df, "k", 0.1).where("part = 'val'").count()
    assert 60 < part < 140
    assert [sampling.head_split_size(*a) for a in ((10, 0.02), (1, 0.02), (10, 1.0), (10, 0))] == [1, 0, 9, 0]
    assert sampling.head_split(df, ["k"], 0.02).where("part = 'val'").count() == 20
    dup = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "g string, o int")
    assert {(r.o, r.is_first) for r in sampling.first_occurrence(dup, F.col("g"), ["o"]).collect()} == {(1, True), (2, False), (3, True), (4, False)}
    assert sampling.limit_per_group(dup, "g", ["o"], 1).count() == 2


def test_datasets(spark):
    df = spark.createDataFrame([("word",), ('["a","b"]',), ("",), (None,)], "t string")
    assert [r.v for r in df.select(datasets.question_types(F.col("t")).alias("v")).collect()] == [["word"], ["a", "b"], [], []]
    a, b = F.array(F.lit(3), F.lit(1)), F.array(F.lit(1))
    assert one(spark, datasets.page_sets(a, b)["only_a"]) == [3]
    assert one(spark, datasets.normalised_pages(F.array(F.lit(1), F.lit(3)), F.lit(True))) == [0, 2]
    assert one(spark, datasets.question_pages(F.lit("not json"))) == []
    assert one(spark, conversations.prompt_text(F.lit("Q?"), F.lit(2))) == "Image 1: <image>\n---\nImage 2: <image>\n---\nQ?"
