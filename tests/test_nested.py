import json

from lumenloom.operators import nested
from lumenloom.plans.training_data import PAYLOAD_SCHEMAS, PAYLOAD_TABLES


def shredded(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "payload_id bigint, payload string")
    out = nested.shred(df, PAYLOAD_TABLES, "payload_id", "payload", root="payload").collect()
    return [(r.payload_id, r.tag, r.parent_no, r.child_no) for r in out if r.tag != "payload"], out


def test_links_shapes_and_null_elements(spark):
    refs = [{"presented_img_idx": 0}, None, {"presented_img_idx": "1", "parent_presented_img_idx": 0.0}, {"presented_img_idx": 1, "parent_presented_img_idx": "1"}, {"parent_presented_img_idx": 9}, {"parent_presented_img_idx": True}]
    details = {"kind": "map", "regions": [{"bbox": [1]}, None, "text"]}
    payload = {
        "presented_image_refs": json.dumps(refs),
        "extra_info": json.dumps({"question_involved_visual_details": json.dumps(details)}),
        "failure_events": ["plain", {"prompt_length_estimate_metadata": {"per_image": {"img": 0}}}],
    }
    got, rows = shredded(spark, [json.dumps(payload)])
    ref, det, ev = "presented_image_refs", "question_involved_visual_details", "failure_events"
    assert got == [
        (0, ref, -1, 0), (0, ref, 0, 2), (0, ref, 2, 3), (0, ref, -1, 4), (0, ref, -1, 5),
        (0, det, -1, 0), (0, f"{det}.regions", 0, 0), (0, f"{det}.regions", 0, 2),
        (0, ev, -1, 0), (0, ev, -1, 1), (0, f"{ev}.per_image", 1, 0),
    ]
    keys = {r.pk for r in rows}
    assert all(r.parent_pk in keys for r in rows if r.parent_pk is not None)
    assert len(keys) == len(rows)


def test_unreadable_and_wrapped_payloads(spark):
    good = json.dumps({"failure_events": [{}]})
    got, _ = shredded(spark, [None, "", "{", good + " x", "[]", "5", json.dumps(good), json.dumps({"failure_events": None, "extra_info": "no json"}), good])
    assert got == [(6, "failure_events", -1, 0), (8, "failure_events", -1, 0)]


def test_repeated_rows_and_empty_table(spark):
    good = json.dumps({"failure_events": [{}]})
    df = spark.createDataFrame([(1, good, "x"), (1, good, "y"), (None, good, "z")], "payload_id bigint, payload string, tag string")
    assert nested.shred(df, PAYLOAD_TABLES, "payload_id", "payload").count() == 3
    assert nested.shred(df.limit(0), PAYLOAD_TABLES, "payload_id", "payload").count() == 0


def test_tagged_store_round_trip(spark, tmp_path):
    payload = json.dumps({"presented_image_refs": [{"presented_img_idx": 0, "kind": "initial", "pk": "own"}], "failure_events": [{"kind": "k"}]})
    df = spark.createDataFrame([(1, payload)], "payload_id bigint, payload string")
    nested.write_tagged(nested.shred(df, PAYLOAD_TABLES, "payload_id", "payload"), str(tmp_path / "store"))
    table = nested.read_table(spark, str(tmp_path / "store"), "presented_image_refs", "kind string, pk string, absent int")
    row = table.first()
    assert (row.kind, row.body_pk, row.absent, row.pk) == ("initial", "own", None, "1/presented_image_refs:0")


def test_boxes_anywhere(spark):
    box = {"left": 1, "top": "2", "width": 3, "height": 4, "page": 5}
    deep = box
    for _ in range(300):
        deep = {"a": [deep]}
    df = spark.createDataFrame([(1, json.dumps([deep, {**box, "width": 0}, {**box, "page": None}])), (2, None), (3, "{")], "id int, text string")
    assert [(r.id, r.page, r.box) for r in nested.harvest_boxes(df, "id", "text").collect()] == [(1, 5, [1.0, 2.0, 4.0, 6.0])]


def test_all_tables_are_linked(spark, tmp_path):
    payloads = [{"extra_info": json.dumps({"question": "q", "question_involved_visual_details": [{"kind": "map", "regions": [{"bbox": [1.0], "label": "l"}]}]}), "presented_image_refs": [{"presented_img_idx": 0}, {"parent_presented_img_idx": 0}], "failure_events": []}] * 2
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "payload_id bigint, payload string")
    nested.write_tagged(nested.shred(df, PAYLOAD_TABLES, "payload_id", "payload", root="payload"), str(tmp_path / "store"))
    tables = {tag: nested.read_table(spark, str(tmp_path / "store"), tag, schema) for tag, schema in PAYLOAD_SCHEMAS.items()}
    report = {r.tag: tuple(r)[1:] for r in nested.link_report(tables, "payload").collect()}
    assert report == {
        "payload": (2, 2, 2, 2), "presented_image_refs": (4, 4, 4, 4), "question_involved_visual_details": (2, 2, 2, 2), "question_involved_visual_details.regions": (2, 2, 2, 2),
    }
    assert json.loads(tables["payload"].first().extra_info) == {"question": "q"}
