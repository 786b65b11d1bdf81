"""Rescue-column ingestion and the change report, against a plain Python version."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import drift

SCHEMA = "line_id bigint, feed string, file_name string, exported_at timestamp, line_no int, line string"
KEY = {"document_id": "string", "question": "string"}


def rows(spark, files):
    """files: list of (feed, file, day, lines)."""
    out, n = [], 0
    for feed, file, day, lines in files:
        for line in lines:
            n += 1
            out.append((n, feed, file, None if day is None else f"2025-01-{day:02d} 00:00:00", n, line if line is None or isinstance(line, str) else json.dumps(line)))
    text = SCHEMA.replace("exported_at timestamp", "exported_at string")
    return spark.createDataFrame(out, text).withColumn("exported_at", F.col("exported_at").cast("timestamp"))


def found(df):
    return {tuple(r) for r in df.select("file_name", "change", "old_field", "new_field").collect()}


def record(d, **more):
    return {"document_id": f"d{d}", "question": f"q{d}", **more}


def test_renamed_added_removed_and_types(spark):
    a = [record(i, question_id=f"m{i}", kind="x", gone=1, n=i) for i in range(5)]
    b = [record(i, uid=f"m{i}", kind=["x"], fresh=True, n=str(i)) for i in range(2, 8)]
    got = found(drift.change_report(rows(spark, [("f", "1", 1, a), ("f", "2", 2, b)]), KEY))
    assert got == {
        ("2", "renamed", "question_id", "uid"), ("2", "removed", "gone", ""), ("2", "added", "", "fresh"),
        ("2", "type_changed", "kind", "kind"), ("2", "type_changed", "n", "n"),
    }


def test_rename_with_another_type(spark):
    a = [record(i, category={"main": f"t{i}", "others": ["u"]}) for i in range(4)]
    b = [record(i, kind=f'["t{i}", "u"]') for i in range(4)]
    assert found(drift.change_report(rows(spark, [("f", "1", 1, a), ("f", "2", 2, b)]), KEY)) == {("2", "renamed", "category", "kind"), ("2", "type_changed", "category", "kind")}


def test_unreadable_repeated_and_null_lines_change_nothing(spark):
    a = [record(1, x=1), record(2, x=2)]
    noise = ["", None, "{", '{"y": 1} {"z": 2}', "[1]", "null", '{"a": 1},{"b": 2}', "{'x': 1}"]
    got = found(drift.change_report(rows(spark, [("f", "1", 1, [*a, *a, *noise]), ("f", "2", 2, [*noise, *a])]), KEY))
    assert got == set()


def test_order_is_by_export_then_name_and_null_presence_counts(spark):
    files = [("f", "b", 2, [record(1, x=None)]), ("f", "a", 1, [record(1, x=1)]), ("f", "c", 3, [record(1)]), (None, "z", 1, [record(1, q=1)])]
    assert found(drift.change_report(rows(spark, files), KEY)) == {("c", "removed", "x", "")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.change_report(empty, KEY).count() == 0
    assert drift.rescue_ingest(empty, KEY).count() == 0


def test_ingest_keeps_what_does_not_fit_and_promote_replays_it(spark):
    target = {"question_id": "string", "n": "bigint", "images": "array<string>"}
    lines = rows(spark, [("f", "1", 1, [{"question_id": "a", "n": 5, "images": ["i"]}, {"question_id": 7, "n": "6", "images": "j", "other": {"k": [1]}}, {"n": 1.5, "images": ["a", 2]}, {"question_id": None}])])
    got = {r.line_id: r for r in drift.rescue_ingest(lines, target).collect()}
    assert (got[1].question_id, got[1].n, got[1].images, got[1]._rescued) == ("a", 5, ["i"], {})
    assert (got[2].question_id, got[2].n, got[2].images) == (None, None, None)
    assert got[2]._rescued == {"question_id": "7", "n": '"6"', "images": '"j"', "other": '{"k":[1]}'}
    assert got[3]._rescued == {"n": "1.5", "images": '["a",2]'}
    assert got[4]._rescued == {"question_id": "null"}
    back = {r.line_id: r for r in drift.promote(drift.rescue_ingest(lines, target), target).collect()}
    assert (back[2].question_id, back[2].n, back[2].images, back[2]._rescued) == ("7", 6, ["j"], {"other": '{"k":[1]}'})
    assert back[4]._rescued == {}


def test_clashing_columns_are_kept_apart(spark):
    lines = rows(spark, [("f", "1", 1, [{"feed": "inner", "x": 1}])])
    row = drift.rescue_ingest(lines, {"feed": "string", "x": "bigint"}).first()
    assert (row.feed, row._file_feed, row.x) == ("inner", "f", 1)


def test_consistent_table_follows_chains_of_names(spark):
    def part(name, lo):
        return [record(i, **{name: f"m{i}"}) for i in range(lo, lo + 4)]

    files = [("f", "1", 1, part("question_id", 0)), ("f", "2", 2, part("uid", 2)), ("f", "3", 3, part("q_id", 4))]
    table = drift.consistent_table(rows(spark, files), {**KEY, "question_id": "string"})
    assert all(r.question_id == "m" + r.question[1:] and r._rescued == {} for r in table.collect())


def test_a_name_is_read_as_what_it_was_in_its_feed(spark):
    def part(ids, **names):
        return [record(i, **{name: f"{what}{i}" for what, name in names.items()}) for i in ids]

    target = {**KEY, "answer": "string", "note": "string"}
    files = [
        ("f", "f1", 1, part(range(4), a="answer", n="note")), ("f", "f2", 2, part(range(2, 6), a="value", n="note")), ("f", "f3", 3, part(range(4, 8), a="value", n="note")),
        ("g", "g1", 1, part(range(10, 14), a="answer", n="note")), ("g", "g2", 2, part(range(12, 16), a="answer", n="value")),
        ("h", "h1", 1, part(range(20, 24), a="answer", n="note")), ("h", "h2", 2, part(range(22, 26), a="text", n="note")), ("h", "h3", 3, part(range(24, 28), a="text", n="memo")),
        ("i", "i1", 1, part(range(30, 32), a="text")),
    ]
    table = drift.consistent_table(rows(spark, files), target)
    for r in table.collect():
        i = r.question[1:]
        assert r.answer == f"a{i}", r
        assert r.note == (None if r.feed == "i" else f"n{i}"), r
        assert r._rescued == {}
    assert table.count() == sum(len(x[3]) for x in files)


def test_comparable_values(spark):
    texts = ["5", '"5"', "[5]", '"[5]"', '{"a": 5}', '"{\\"a\\": 5}"', "5.0", '["x", "Y z"]', '"x,  y Z"', "null", '""', "[]", "true"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(drift.comparable(F.col("t")).alias("v")).collect()]
    assert len(set(got[:7])) == 1 and got[7] == got[8] and got[9:12] == [None] * 3 and got[12] is not None


def test_unreadable_lines(spark):
    lines = rows(spark, [("f", "1", 1, ["{}", "", None, "x"]), ("f", "2", 1, ["{}"])])
    assert {(r.file_name, r.n_lines, r.n_unreadable) for r in drift.unreadable_lines(lines).collect()} == {("1", 4, 3), ("2", 1, 0)}


def brute(files):
    """The change report without Spark, for files whose lines are objects."""
    kind = lambda v: {bool: "boolean", str: "string", list: "array", dict: "object"}.get(type(v), "number")
    out, feeds = set(), defaultdict(list)
    for feed, file, day, lines in files:
        feeds[feed].append((day, file, lines))
    for parts in feeds.values():
        parts.sort(key=lambda p: (p[0], p[1]))
        for (_, _, old), (_, file, new) in zip(parts, parts[1:]):
            have = [{k for x in side for k in x} for side in (old, new)]
            kinds = [{k: {kind(x[k]) for x in side if x.get(k) is not None} for k in ks} for side, ks in zip((old, new), have)]
            by = [{(x["document_id"], x["question"]): x for x in side} for side in (old, new)]
            gone, come, pairs = have[0] - have[1], have[1] - have[0], []
            for o in gone:
                for n in come:
                    both = [(by[0][r].get(o), by[1][r].get(n)) for r in by[0].keys() & by[1].keys()]
                    both = [(a, b) for a, b in both if a is not None or b is not None]
                    if both and all(a is not None and b is not None and str(a) == str(b) for a, b in both):
                        pairs.append((o, n))
            for o, n in pairs:
                out.add((file, "renamed", o, n))
            out |= {(file, "removed", o, "") for o in gone - {p[0] for p in pairs}}
            out |= {(file, "added", "", n) for n in come - {p[1] for p in pairs}}
            for o, n in [*((k, k) for k in have[0] & have[1]), *pairs]:
                if kinds[0][o] and kinds[1][n] and kinds[0][o] != kinds[1][n]:
                    out.add((file, "type_changed", o, n))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    files = []
    for feed in "AB":
        names = {f"f{i}": f"f{i}" for i in range(4)}
        pool = {}
        for day in range(1, 6):
            lines = []
            if day > 1 and r.random() < 0.9:
                f = r.choice(list(names))
                names[f] = f"{f}_{day}"
            ids = [*r.sample(list(pool), min(4, len(pool))), *(f"{day}-{k}" for k in range(4))]
            for i in ids:
                values = pool.setdefault(i, {f: f"{feed}{i}{f}" for f in names})
                lines.append({"document_id": f"d{i}", "question": f"q{i}", **{names[f]: v for f, v in values.items()}})
            files.append((feed, f"{feed}{day}", day, lines))
    assert found(drift.change_report(rows(spark, files), KEY)) == brute(files)
