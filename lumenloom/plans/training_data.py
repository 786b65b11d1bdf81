"""Queries of the general training-data operators: drifting schemas and nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import drift, nested
from lumenloom.plans.registry import Registry, table
from lumenloom.session import scratch

REGISTRY = Registry()

#: The manifest's fields, into which the lines of all feeds are read.
MANIFEST_FIELDS = {
    "question_id": "string",
    "document_id": "string",
    "question": "string",
    "answer": "string",
    "images": "array<string>",
    "subset": "string",
    "data_source": "string",
    "question_type": "string",
    "question_involved_visuals": "string",
    "question_involved_visual_details": "string",
    "initial_rescale": "double",
}

#: Two fields of a record that never change.
RECORD_KEY = {"document_id": "string", "question": "string"}


@REGISTRY.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of fields between consecutive files of a feed."""
    report = drift.change_report(table(spark, sf_dir, "manifest_lines"), RECORD_KEY, tuple(RECORD_KEY))
    return report.select("file_name", "change", "old_field", "new_field")


@REGISTRY.add("p1_table")
def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable records in one table, renamed fields replayed, the rest rescued."""
    return drift.consistent_table(table(spark, sf_dir, "manifest_lines"), MANIFEST_FIELDS, tuple(RECORD_KEY))


#: The arrays of an export payload and their links.
PAYLOAD_TABLES = (
    nested.ChildTable("presented_image_refs", ("presented_image_refs",), self_link=("presented_img_idx", "parent_presented_img_idx")),
    nested.ChildTable(
        "question_involved_visual_details",
        ("extra_info", "question_involved_visual_details"),
        (nested.ChildTable("question_involved_visual_details.regions", ("regions",)),),
    ),
    nested.ChildTable(
        "failure_events",
        ("failure_events",),
        (nested.ChildTable("failure_events.per_image", ("prompt_length_estimate_metadata", "per_image")),),
    ),
)


@REGISTRY.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of a payload's arrays with its parent's place."""
    tagged = nested.shred(table(spark, sf_dir, "export_payloads"), PAYLOAD_TABLES, "payload_id", "payload", body=False)
    return tagged.select("payload_id", F.col("tag").alias("child_field"), "parent_no", "child_no")


@REGISTRY.add("p4_tables")
def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat tables as one tagged stream: keys, parent keys and bodies, the payload itself included."""
    return nested.shred(table(spark, sf_dir, "export_payloads"), PAYLOAD_TABLES, "payload_id", "payload", root="payload")


#: The fields that each table's elements are read into; what else an element holds stays in its body.
PAYLOAD_SCHEMAS = {
    "payload": "request_id string, conversation_export_id string, raw_prompt string, messages string, actual_initial_rescale double, initial_rescale_metadata string, extra_info string, critical_failure boolean, final_failure_reasons array<string>",
    "presented_image_refs": "presented_img_idx string, parent_presented_img_idx string, kind string, source_original_img_idx int, bbox_on_original array<int>, display_size array<int>, original_size array<int>, region_description string, zoom_in_factor double",
    "question_involved_visual_details": "kind string, page int, caption string",
    "question_involved_visual_details.regions": "bbox array<double>, label string",
    "failure_events": "kind string, status string, state string, tool_name string, error_type string, error_message string, prompt_tokens int, requested_max_tokens int, available_new_tokens int, prompt_length_limit int",
    "failure_events.per_image": "img int, tokens int",
}


def _typed(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    return nested.apply_schema(p4_tables(spark, sf_dir).where(F.col("tag") == tag), PAYLOAD_SCHEMAS[tag])


@REGISTRY.add("p4_crops")
def p4_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of presented images with its schema applied."""
    return _typed(spark, sf_dir, "presented_image_refs")


@REGISTRY.add("p4_regions")
def p4_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of regions of the visual details with its schema applied."""
    return _typed(spark, sf_dir, "question_involved_visual_details.regions")


@REGISTRY.add("p4_events")
def p4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of failure events with its schema applied."""
    return _typed(spark, sf_dir, "failure_events")


@REGISTRY.add("p4_store")
def p4_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables written partitioned by tag in one pass, read back with their schemas, and held against each other: rows, keys, typed rows and links of each."""
    path = scratch(spark)
    nested.write_tagged(p4_tables(spark, sf_dir), path)
    tables = {tag: nested.read_table(spark, path, tag, schema) for tag, schema in PAYLOAD_SCHEMAS.items()}
    return nested.link_report(tables, "payload")
