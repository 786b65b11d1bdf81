"""Chat messages, records and image references on hand-made cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import samples as S
from lumenloom.operators import records as R


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("prompt, urls, want", [
    ([("system", "be"), ("user", "<image>a<image>\nb")], ["u", "v"], [("system", ["be"]), ("user", ["!u", "a", "!v", "\nb"])]),
    ([("user", "<image>"), (None, "x<image>")], ["u"], [("user", ["!u"]), ("user", ["x"])]), ([("user", "a"), ("assistant", "b")], ["u", "v"], [("user", ["a"]), ("assistant", ["!u", "!v", "b"])]),
    ([], ["u"], [("user", ["!u"])]), ([], [], []), (None, None, []), ([("user", None)], None, [("user", [])]),
])
def test_chat_messages(spark, prompt, urls, want):
    df = spark.createDataFrame([(prompt, urls)], f"p {R.MESSAGES}, u array<string>")
    got = df.select(R.chat_messages(F.col("p"), F.col("u"), "high").alias("m")).first().m
    assert [(m.role, [p.text if p.type == "text" else f"!{p.url}" for p in m.parts]) for m in got] == want
    assert all(p.detail == "high" for m in got for p in m.parts if p.type == "image_url")


def test_tool_calls_and_usage(spark):
    text = one(spark, R.tool_call_text(F.lit('zo"om'), F.lit('{"a": [1]}')))
    assert text.startswith("<tool_call>\n") and json.loads(text[12:-13]) == {"name": 'zo"om', "arguments": {"a": [1]}}
    assert json.loads(one(spark, R.tool_call_text(F.lit("z"), F.lit("not json")))[12:-13])["arguments"] == "not json"
    assert [one(spark, R.usage_number(F.lit(u).cast("string"), "n")) for u in ('{"n": 5}', '{"n": "7"}', '{"n": "x"}', "{}", None)] == [5, 7, None, None, None]


def test_sample_records(spark):
    schema = "sample_index bigint, trial_idx int, uid string, data_source string, ground_truth string, question_id string, prompt_messages int, text string, finish_reason string, usage string, failure_reasons array<string>, wall_time_s double, path string"
    df = spark.createDataFrame([(1, 0, "", "s", "g", "q", 2, "hi", "length", '{"prompt_tokens": 3, "completion_tokens": 4}', [], 1.5, "p"), (2, 1, None, None, None, None, 1, None, None, None, ["e"], None, None)], schema)
    a, b = R.sample_records(df, "agent").collect()
    assert (a.uid, a.num_turns, a.response_truncated, a.critical_failure, a.prompt_tokens, a.response_tokens_generated, a.extra_info.agent_name) == ("q", 3, True, False, 3, 4, "agent")
    assert (b.uid, b.num_turns, b.solution_str, b.critical_failure, b.response_tokens_total) == ("2", 1, "", True, None)


def ref(**fields):
    return F.struct(*[F.lit(fields.get(n)).cast("string").alias(n) for n in ("source_type", "path", "value", "url", "uri")])


def test_references(spark):
    values = [ref(source_type="path", path="/a", value="x"), ref(source_type="path_or_url", url="http://h/i"), ref(source_type="url", value="v"), ref(source_type="other", path="/p"), ref()]
    assert [one(spark, R.ref_value(v)) for v in values] == ["/a", "http://h/i", "v", "/p", None]
    paths = [ref(value="file:///a/b.jpg"), ref(value="/c"), ref(value="HTTPS://x"), ref(value="data:image/png;base64,x"), ref(value="")]
    assert [one(spark, R.local_path(v)) for v in paths] == ["/a/b.jpg", "/c", None, None, None]
    got = one(spark, R.rewritten_refs(F.array(ref(value="/old/x", uri="/older/y"), ref(path="/old")), {"/old": "/new"}))
    assert got.changed and [(r.path, r.value, r.uri) for r in got.refs] == [(None, "/new/x", "/older/y"), ("/new", None, None)]
    assert not one(spark, R.rewritten_refs(F.array(ref(value="/x")), {"/old": "/new"})).changed


def test_packing_references(spark):
    images = spark.createDataFrame([("file:/d/a b.jpg", b"x"), ("file:///d/plain", b"y")], "path string, content binary")
    refs = [("path_or_url", None, "file:///d/a b.jpg", None, None), ("path", "/d/plain", None, None, None), ("path", "/d/gone.png", None, None, None), ("url", None, None, "http://h/i", None), ("data_url", None, None, "data:x", None), None]
    records = spark.createDataFrame([("r.json", refs)], f"json_name string, input_images array<{R.REF}>")
    packed, problems = R.pack_references(records, images)
    digest = lambda b: hashlib.sha1(b).hexdigest()[:16]
    assert {r.idx: r.packed for r in packed.collect()} == {0: f"images/{digest(b'x')}_a-b.jpg", 1: f"images/{digest(b'y')}_plain.img", 2: None, 3: None, 4: None}
    assert {(r.idx, r.problem) for r in problems.collect()} == {(2, "missing"), (3, "nonlocal")}


def test_numbers_of_samples(spark):
    score = lambda **kv: F.create_map(*[F.lit(x).cast("string") for pair in kv.items() for x in pair])
    own = {"n_tool_calls": F.lit(5), "prompt_tokens": F.lit(10), "response_tokens_total": F.lit(5)}
    assert one(spark, S.sample_number("n_tool_calls", score(n_tool_calls=2), own)) == 2
    assert one(spark, S.sample_number("n_tool_calls", score(n_tool_calls=None), own)) is None
    assert one(spark, S.sample_number("n_tool_calls", F.lit(None).cast("map<string,string>"), own)) == 5
    assert one(spark, S.sample_number("total_tokens", score(score="0.5"), own)) == 15
    assert one(spark, S.sample_number("score", score(score="0.5"), {})) == 0.5
    assert one(spark, S.sample_number("score", score(score="nan"), {})) is None
