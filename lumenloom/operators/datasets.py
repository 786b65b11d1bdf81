"""Training and evaluation rows from manifests: typed reading, projections, evidence and page logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.functions.geometry import valid_box

#: Regions of a page that a question involves, as the manifest's JSON text holds them.
DETAILS = "array<struct<kind:string,page:int,caption:string,regions:array<struct<bbox:array<double>,label:string>>>>"


def visual_details(text: Column) -> Column:
    """The manifest's visual details, read by schema; an empty array for null or unreadable text."""
    return F.coalesce(F.from_json(text, DETAILS), F.array().cast(DETAILS))


def evidence_boxes(rows: DataFrame, keys: tuple[str, ...], details: str = "question_involved_visual_details") -> DataFrame:
    """One row per valid region box: keys, kind, page, label, box."""
    each = rows.select(*keys, F.inline(visual_details(F.col(details))))
    return each.select(*keys, "kind", "page", F.inline("regions")).select(*keys, "kind", "page", "label", valid_box(F.col("bbox")).alias("box")).where("box is not null")


def question_pages(details: Column) -> Column:
    """Sorted distinct pages of the details."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(visual_details(details), lambda d: d["page"]), lambda p: p.isNotNull())))


def question_types(value: Column) -> Column:
    """A question type given as a word or as a JSON list, as an array; empty for null and blank."""
    listed = F.from_json(value, "array<string>")
    word = F.when(F.trim(value) != "", F.array(F.trim(value)))
    return F.coalesce(F.when(value.startswith("["), listed), word, F.array().cast("array<string>"))


def image_urls(images: Column, root: str) -> Column:
    """file:// URLs of the images."""
    return F.transform(images, lambda i: F.concat(F.lit(f"file://{root.rstrip('/')}/"), i))


def rl_rows(rows: DataFrame, agent: str, style: str = "rule") -> DataFrame:
    """Rows for reinforcement learning and evaluation: data_source, agent_name, prompt, images, reward_model, extra_info.

    The prompt has one <image> tag per image, the tags of the question itself
    removed. Rows without an image or a question are left out.
    """
    n = F.size("images")
    question = F.replace(F.col("question"), F.lit("<image>"), F.lit(""))
    content = F.concat(F.repeat(F.lit("<image>"), n), question)
    kept = rows.where((n > 0) & (F.trim(question) != ""))
    return kept.select(
        "data_source", F.lit(agent).alias("agent_name"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
        F.transform("images", lambda i: F.struct(i.alias("image"))).alias("images"), F.struct(F.lit(style).alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"),
        F.struct("split", F.col("row_id").alias("index"), "question", "question_id", "document_id", "subset", "question_type", "initial_rescale").alias("extra_info"),
    )


def region_rows(rows: DataFrame) -> DataFrame:
    """Region localisation rows: question_id (the sample's id if it has none), page image (its path, else the default one), escaped target, box."""
    default = F.concat(F.lit("images/"), F.col("document_id"), F.lit("/"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".jpg"))
    return rows.select(
        "sample_id", F.coalesce("question_id", "sample_id").alias("question_id"), F.coalesce("page_image_path", default).alias("image"),
        F.replace(F.col("region_description"), F.lit("<image>"), F.lit("< image >")).alias("target"), valid_box(F.col("bbox")).alias("box"),
    )


def pages_of_images(images: Column) -> Column:
    """Page numbers of image paths, those without one left out."""
    return F.filter(F.transform(images, T.page_of_path), lambda p: p.isNotNull())


def page_sets(a: Column, b: Column) -> dict[str, Column]:
    """Union, intersection and difference of two page arrays, sorted, and whether all of a is in b."""
    return {
        "both": F.array_sort(F.array_union(a, b)),
        "common": F.array_sort(F.array_intersect(a, b)),
        "only_a": F.array_sort(F.array_except(a, b)),
        "covered": F.size(F.array_except(a, b)) == 0,
    }


def normalised_pages(pages: Column, one_based: Column, start: Column | None = None) -> Column:
    """Pages as positions among the input images: one less where they count from 1, and relative to the first page of a slice."""
    shift = F.when(one_based, 1).otherwise(0) + (F.coalesce(start, F.lit(0)) if start is not None else F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(pages, lambda p: p - shift), lambda p: p >= 0)))


def corners(box: Column) -> Column:
    """A box given as x, y, width, height as [x1, y1, x2, y2]."""
    x, y = F.get(box, F.lit(0)), F.get(box, F.lit(1))
    return F.array(x, y, x + F.get(box, F.lit(2)), y + F.get(box, F.lit(3)))


def question_with_options(question: Column, options: Column) -> Column:
    """A question and its options on the next line, line breaks written as \\n made real."""
    return F.replace(F.concat(question, F.lit("\n"), options), F.lit("\\n"), F.lit("\n"))


#: How each kind of benchmark is read: its question, its id, and the further fields of extra_info.
BENCHMARKS = {
    "multiple_choice": {"question": "options", "id": "question_id", "extra": ("subset",)},
    "search": {"question": "options", "id": "question_id", "extra": ("category", "bboxes")},
    "collage": {"question": "plain", "id": "index", "extra": ("qa_pairs", "n_layouts", "layout_types", "core_layout_coord", "core_target_bbox", "has_ref")},
    "region": {"question": "description", "id": "question_id", "extra": ("search_target", "bboxes")},
}


def benchmark_rows(rows: DataFrame, kind: str, data_source: str, root: str = "") -> DataFrame:
    """Rows of a benchmark as data_source, question, answer, image (file:// URL) and extra_info.

    `kind` (BENCHMARKS) tells how: multiple_choice and search join the question
    with its options, search takes its boxes as corners, collage takes its row
    index as id and says has_ref, region asks for its description and answers
    with its box. A field that a kind knows and the rows lack is null.
    """
    spec = BENCHMARKS[kind]
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    question = {"options": question_with_options(has("question"), has("options")), "plain": has("question"), "description": has("region_description")}[spec["question"]]
    numbers = lambda b: F.concat(F.lit("["), F.array_join(F.transform(b, lambda v: v.cast("string")), ", "), F.lit("]"))
    boxes = F.transform(F.col("boxes"), corners) if kind == "search" and "boxes" in rows.columns else F.array(F.col("bbox")) if kind == "region" else F.lit(None).cast("array<array<double>>")
    known = {"bboxes": boxes, "has_ref": F.lit(True), "search_target": has("region_description")}
    extra = F.struct(question.alias("question"), has(spec["id"]).cast("string").alias("question_id"), *[known.get(c, has(c)).alias(c) for c in spec["extra"]])
    answer = numbers(F.col("bbox")) if kind == "region" else has("answer")
    image = F.concat(F.lit(f"file://{root.rstrip('/')}/"), has("image"))
    return rows.select(F.lit(data_source).alias("data_source"), question.alias("question"), answer.alias("answer"), image.alias("image"), extra.alias("extra_info"))


def reconciled(expected: DataFrame, rows: DataFrame, source: str = "source", size: str = "expected") -> DataFrame:
    """Expected rows of each source beside those there are: source, expected, actual (0 for none), matches (null where nothing is expected).

    Sources that aren't expected but have rows are kept, null sources are one.
    """
    have = rows.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("actual"))
    joined = expected.select(source, size, F.lit(True).alias("_known")).join(have, F.col(source).eqNullSafe(F.col("_source")), "full_outer")
    name = F.when(F.col("_known").isNotNull(), F.col(source)).otherwise(F.col("_source"))
    actual = F.coalesce("actual", F.lit(0).cast("bigint"))
    return joined.select(name.alias(source), F.col(size).alias("expected"), actual.alias("actual"), (F.col(size) == actual).alias("matches"))
