import random

import pytest

from lumenloom.llm import overlap
from lumenloom.llm.questions import Vocabulary, content, document_key, near_word, same_content

WORDS = Vocabulary({w: 100 for w in "floor area rail gauge water depth strength crew station bridge".split()})
SCHEMA = "row_id bigint, document_id string, question string, split string, data_source string, extra int"


@pytest.mark.parametrize("text", [
    "What is the floor area of Bardo Bridge on page 7?", "WHAT IS THE FLOOR AREA OF BARDO BRIDGE ON PAGE 7??", "<p>State&nbsp;the floor area of Bardo Bridge on page 7.</p>",
    "Whаt is thе floor area of Bárdo Bridge on page 7", "Question 4) I need the floor area recorded for Bardo Bridge on page 07; what does it say?",
    "Please report Bardo Bridge's flor aera on pgae 7.\n(A) 12\n(B) 13", "<image><image>\nFor Bardo Bridge, what floor area is shown on page 7? Thanks!",
    "On page 7, what is the floor area of Bardo Bridge? A. 1 B. 2 C. None of the above", "Ｗhat floor area is given for Bardo Bridge on page 7? (short answer)",
])
def test_ways_to_write_a_question(text):
    assert same_content(content(text, WORDS), ["floor", "area", "bardo", "bridge", "page7"], WORDS)


@pytest.mark.parametrize("text", [None, "", "  ", "n/a", "N/A.", "?"])
def test_questions_that_ask_nothing(text):
    assert content(text, WORDS) == []


@pytest.mark.parametrize("other", ["rail gauge bardo bridge page7", "floor area bardu bridge page7", "floor area bardo bridge page8", "floor area bardo bridge table7", "floor area bardo station page7", "floor area bardo bridge"])
def test_other_questions(other):
    assert not same_content("floor area bardo bridge page7".split(), other.split(), WORDS)


def test_slips():
    assert near_word("gauge", "gage") and near_word("width", "witdh") and not near_word("floor", "roof")
    assert same_content(["crew", "strength", "x"], ["crew", "sttrenngth", "x"], WORDS)
    assert document_key("docs/Tide-00000231-Lun.PDF") == document_key("./tide_00000231_lun") == "tide_00000231_lun"


def brute(rows):
    words = Vocabulary({})
    out = set()
    for a in rows:
        for b in rows:
            if a[3] == "train" and b[3] in ("val", "test") and a[1] and b[1] and document_key(a[1]) == document_key(b[1]):
                x, y = content(a[2], words), content(b[2], words)
                if x and y and sorted(x) == sorted(y):
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


@pytest.mark.parametrize("block, slice_", [(2000, 20000), (1, 2)])
def test_pairs_against_brute_force(spark, monkeypatch, block, slice_):
    r = random.Random(5)
    names, things = ["Bardo", "Kelso", "Minfa", "Rastu"], ["floor area", "rail gauge", "depth"]
    forms = ["What is the {t} of {n}?", "FOR {n}, WHAT {t} IS SHOWN?", "Please report {n}'s {t}."]
    rows = []
    for i in range(300):
        doc = "hot" if i % 3 == 0 else r.choice(["d1", "D1.pdf", "x/d2", None, ""])
        q = r.choice(forms).format(t=r.choice(things), n=r.choice(names)) if i % 17 else r.choice([None, "", "n/a"])
        rows.append((i, doc, q, r.choice(["train", "train", "val", "test", None]), r.choice(["s", None]), i))
    df = spark.createDataFrame(rows, SCHEMA)
    plain = overlap.scan
    monkeypatch.setattr(overlap, "scan", lambda texts, words: plain(texts, words, block=block, slice_=slice_))
    got = [tuple(x) for x in overlap.cross_split_pairs(df).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))
    report = overlap.overlap_report(df).collect()
    assert sum(x.n_pairs for x in report) == len(got)
    assert sum(x.n_rows for x in report) == sum(1 for x in rows if x[3] in ("val", "test"))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert overlap.cross_split_pairs(df).count() == 0
    assert overlap.overlap_report(df).count() == 0


def test_coverage(spark):
    rows = [(1, "d", "What is the depth of Bardo?", "train", "s", 0), (2, "d", "State the depth of Bardo.", "val", "s", 0), (3, "d", "State the depth of Kelso.", "val", "s", 0)]
    got = overlap.evaluation_coverage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.row_id, r.coverage, r.n_texts) for r in got] == [(2, 1.0, 1)]


def test_repetitions_share_a_shard():
    words = Vocabulary({w: 100 for w in "temperature insurance value boiler pressure station bardo floor area".split()})
    slipped = [
        (["insurance", "value", "kelso"], ["insuranze", "value", "kelso"]), (["temperature", "bardo"], ["tempreatrue", "bardo"]), (["boiler", "pressure"], ["boilr", "pressure"]),
        (["temperature", "station"], ["tempreatrue", "station"]), (["floor", "area", "page7"], ["area", "flor", "page7"]), (["value", "x9"], ["value", "x9", "teh"]),
    ]
    for a, b in slipped:
        assert same_content(a, b, words)
        assert set(overlap.anchors(a, words)) & set(overlap.anchors(b, words)), (a, b)
    assert overlap.anchors(["floor", "kelso", "page7"], words) == overlap.anchors(["page7", "area", "kelso"], words) == ["=kelso page7"]


def test_intervals_are_merged_into_coverage():
    assert overlap.merged([(0, 3), (2, 5), (5, 6), (9, 10), (0, 1)]) == 7
    shard = overlap.Shard()
    shard.add(1, ["floor", "area", "bardo", "bridge"])
    shard.add(2, ["kelso"])
    assert dict(shard.covered(["bridge", "floor", "area"], 0.1)) == {0: pytest.approx(15 / 20)}
    assert dict(shard.covered(["floor", "area", "bardo", "bridge", "kelso"], 0.9)) == {0: 1.0, 1: 1.0}
    assert dict(overlap.Shard().covered(["a"], 0.1)) == {}


def test_a_hot_document_scales_with_its_texts(spark):
    words = Vocabulary({"floor": 1, "area": 1, "depth": 1})
    rows = [(i, "hot", f"{'floor area' if i % 2 else 'depth'} of n{i // 4 % 1000:05d}x", "train" if i % 3 else "val", "s", 0) for i in range(8000)]
    texts = overlap.question_texts(spark.createDataFrame(rows, SCHEMA), words)
    sizes = texts.selectExpr("explode(anchors) as a", "text_id").distinct().groupBy("a").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 2  # a shard holds the two properties of one name
