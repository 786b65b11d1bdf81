"""Sources, sinks and streaming."""

import json

from pyspark.sql import functions as F

from lumenloom.operators.logs import latest_wins
from lumenloom.sources import readers, sinks
from lumenloom.streaming.follow import CompactedTable, follow_completed_keys, follow_log


def line(job, key, at, **sample):
    return json.dumps({"job_idx": job, "job_key": key, "written_at": at, "sample": {"sample_index": job, "trial_idx": 0, **sample}})


def test_checkpoint_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([line(1, "a", 5.0), "", "{broken", line(2, "b", None), json.dumps({"job_key": "c"})]))
    rows = {r.job_key: r for r in readers.read_checkpoints(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].written_at == 5.0 and rows["b"].written_at > 1e9


def test_bare_checkpoint_records(spark, tmp_path):
    lines = [
        {"job_idx": 3, "job_key": "k", "sample_index": 1, "resume_metadata": {"written_at": "x", "finalized_at": 7.5}},
        {"sample": {"job_idx": "4", "resume_metadata": {"job_key": "m", "generated_at": 2}}},
        {"job_idx": 5, "sample": None}, {"job_idx": 6, "sample": "text"}, {"sample_index": 2}, [1],
        {"job_idx": 8, "written_at": "9", "sample": {"job_key": "s"}, "job_key": "e"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r.job_idx: (r.job_key, r.written_at) for r in readers.read_checkpoints(spark, str(tmp_path)).collect()}
    assert got == {3: ("k", 7.5), 4: ("m", 2.0), 8: ("s", 9.0)}


def test_small_readers(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    assert {r.id for r in readers.read_id_list(spark, str(tmp_path / "ids.txt")).collect()} == {"a", "b"}
    (tmp_path / "run.env").write_text("# c\nA=1\nB='x=y'\nA=2\nnothing\n")
    assert {(r.key, r.value) for r in readers.read_settings(spark, str(tmp_path / "run.env")).collect()} == {("A", "2"), ("B", "x=y")}
    (tmp_path / "w.yaml").write_text("a: 0.25 # note\n'b': 0.75\n")
    assert {(r.source, r.weight) for r in readers.read_weights(spark, str(tmp_path / "w.yaml")).collect()} == {("a", 0.25), ("b", 0.75)}
    (tmp_path / "k.json").write_text('{"q1": {"answer": "x"}, "q2": {"answer": null}}')
    assert {(r.id, r.answer) for r in readers.read_keyed_object(spark, str(tmp_path / "k.json"), "answer:string").collect()} == {("q1", "x"), ("q2", None)}
    for n in (0, 1, 2):
        assert readers.read_keyed_object(spark, str(tmp_path / "no.json"), "answer:string").count() == 0
        (tmp_path / "img" / "d").mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / "d" / f"{n:06d}.jpg").write_bytes(b"x")
    assert {(r.document, r.page) for r in readers.read_pages(spark, str(tmp_path / "img"), 1, 3).collect()} == {("d", 1), ("d", 2)}


def test_manifest_and_missing_images(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"question_id": 5, "question_type": ["a", "b"], "images": ["d/000001.jpg", "d/9.jpg"], "initial_rescale": 0.5}) + "\n\n" + json.dumps({"images": None}))
    rows = readers.read_manifest(spark, str(tmp_path / "m.jsonl"))
    first = rows.where("question_id is not null").first()
    assert (first.question_id, json.loads(first.question_type), first.initial_rescale, rows.count()) == ("5", ["a", "b"], 0.5, 2)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "000001.jpg").write_bytes(b"x")
    assert [r.image for r in readers.missing_images(rows, readers.read_pages(spark, str(tmp_path)), str(tmp_path)).collect()] == ["d/9.jpg"]


def test_origin_and_position(spark, tmp_path):
    for name, lo in (("b", 0), ("a", 5)):
        spark.range(lo, lo + 3, numPartitions=1).write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / "b"), str(tmp_path / "a")]
    rows = readers.read_parquet_with_origin(spark, paths, 4).collect()
    assert [(r.id, r.file_no, r.row_index) for r in rows] == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (5, 1, 0)]
    assert readers.count_rows(spark, str(tmp_path / "none")) is None
    numbered = readers.position(spark.range(100).repartition(7), ["id"]).collect()
    assert all(r.id == r["index"] for r in numbered)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "x"), (2, None, "y")], "n int, l array<string>, part string")
    sinks.write_delimited(df, str(tmp_path / "t"), "\t")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).columns == ["l", "n", "part"]
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "part=x")).count() == 1
    sinks.write_ids(df, "n", str(tmp_path / "i"))
    assert [r.value for r in spark.read.text(str(tmp_path / "i")).collect()] == ["1", "2"]
    sinks.write_json_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())[0]["l"] == ["a"]
    sinks.write_markdown(df, str(tmp_path / "r.md"), "Report")
    assert "| 1 |" in (tmp_path / "r.md").read_text()
    sinks.write_jsonl(df, str(tmp_path / "j"), "finalized_at")
    assert "finalized_at" in spark.read.json(str(tmp_path / "j")).columns
    blobs = spark.createDataFrame([(b"x", "p a.jpg"), (b"x", "q.jpg"), (b"y", "r.jpg")], "content binary, name string")
    assert sinks.content_addressed(blobs, "content", "name").count() == 2
    assert df.select(sinks.number(F.lit(123.456)).alias("v")).first().v == "123.5"


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    table = CompactedTable(spark, str(tmp_path / "table"), ["job_key"], ["written_at", "job_idx"])
    seen = []
    for n, lines in enumerate([[line(1, "a", 1.0), line(2, "b", 1.0)], ["{bad", line(1, "a", 3.0, num_turns=9)], [line(1, "a", 2.0), line(3, "c", 1.0)]]):
        (source / f"{n}.jsonl").write_text("\n".join(lines))
        follow_log(spark, str(source), table, str(tmp_path / "cp"), then=lambda rows, _: seen.append(rows.count()), files_per_batch=1).awaitTermination()
    batch = latest_wins(readers.read_checkpoints(spark, str(source)), ["job_key"], ["written_at", "job_idx"])
    assert sorted(map(str, table.read().select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert seen == [2, 2, 3]
    table.upsert(batch.limit(0), table.state()[0])  # a repeated batch changes nothing
    assert table.read().count() == 3
    folders = {p.parent.name for p in (tmp_path / "table").glob("v*/_bucket=*")}
    assert len(folders) <= 3 and len(list((tmp_path / "table").glob("manifest-*.json"))) == 2
    keys = CompactedTable(spark, str(tmp_path / "keys"), ["job_key"], ["at"], buckets=4)
    follow_completed_keys(spark, str(source), keys, str(tmp_path / "cp2")).awaitTermination()
    (source / "9.jsonl").write_text(line(7, "late", -1e6))  # far older than anything before it
    follow_completed_keys(spark, str(source), keys, str(tmp_path / "cp2")).awaitTermination()
    assert {r.job_key for r in keys.read().collect()} == {"a", "b", "c", "late"}
