"""Sources: JSON, JSONL, parquet, delimited text, id lists, run settings and image folders as DataFrames.

Schemas are declared, never inferred, and every reader keeps where a row came from.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions.text import page_of_path, rescale_of_path
from lumenloom.functions.values import clean_text, finite_float
from lumenloom.session import ensure_checkpoint_dir
from lumenloom.sources import files

#: A sample of a rollout log.
SAMPLE = (
    "struct<sample_index:bigint,trial_idx:int,uid:string,data_source:string,question_id:string,ground_truth:string,solution_str:string,response_truncated:boolean,"
    "critical_failure:boolean,failure_reasons:array<string>,num_turns:int,n_tool_calls:int,wall_time_s:double,prompt_tokens:bigint,response_tokens_total:bigint>"
)
SAMPLE_FIELDS = SAMPLE[len("struct<") : -1].split(",")
CHECKPOINT = f"job_idx int, job_key string, written_at double, sample {SAMPLE}, corrupt_record string"
MANIFEST = (
    "question_id string, document_id string, question string, answer string, images array<string>, subset string, data_source string, question_type string, "
    "question_involved_visuals string, question_involved_visual_details string, initial_rescale double"
)
REGIONS = (
    "sample_id string, question_id string, document_id string, page_id int, page_image_path string, region_description string, bbox array<double>, bbox_image array<double>, "
    "description_mode string, block_types array<string>, num_blocks int"
)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, strict: bool = False) -> DataFrame:
    """Lines of JSON by schema. Blank lines are skipped; an unreadable line is an error if strict, else a row of nulls (with its text, if the schema has corrupt_record)."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if "corrupt_record" in schema:
        reader = reader.option("columnNameOfCorruptRecord", "corrupt_record")
    return reader.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with all ids and texts as strings; a question_type that is a list or object comes as its JSON text."""
    return read_jsonl(spark, path, MANIFEST)


def parse_checkpoints(lines: DataFrame) -> DataFrame:
    """Lines of a rollout log (value, file_time) as job_idx, job_key, written_at and sample.

    A line is an envelope if it has the key `sample`, else it is the sample
    itself. job_idx comes from the envelope, then from the sample; job_key from
    the sample, its resume metadata, then the envelope; the time from the
    envelope, then the resume metadata (written_at, finalized_at, generated_at),
    then the file. Unreadable lines, samples that aren't objects, and lines
    without a whole job_idx give no row.
    """
    meta = "resume_metadata:struct<job_key:string,written_at:string,finalized_at:string,generated_at:string>"
    wide = f"{SAMPLE[:-1]},job_idx:string,job_key:string,{meta}>"
    number = lambda c: finite_float(c)
    envelope = F.from_json("value", f"job_idx string, job_key string, written_at string, sample {wide}")
    rows = lines.select(envelope.alias("e"), F.from_json("value", wide).alias("b"), F.json_object_keys("value").alias("keys"), "file_time").where("keys is not null")
    wrapped = F.array_contains("keys", "sample")
    rows = rows.select(F.when(wrapped, F.col("e.sample")).otherwise(F.col("b")).alias("s"), F.when(wrapped, F.col("e.job_idx")).alias("idx"), F.when(wrapped, F.col("e.written_at")).alias("at"), F.col("e.job_key").alias("key"), "file_time")
    m = F.col("s.resume_metadata")
    stamp = F.coalesce(number(F.col("at")), number(m["written_at"]), number(m["finalized_at"]), number(m["generated_at"]), F.unix_timestamp("file_time").cast("double"))
    filled = lambda c: F.when(c != "", c)
    sample = F.struct(*[F.col(f"s.{field.split(':')[0]}").alias(field.split(":")[0]) for field in SAMPLE_FIELDS])
    return rows.where("s is not null").select(
        F.coalesce("idx", "s.job_idx").try_cast("int").alias("job_idx"), F.coalesce(filled(F.col("s.job_key")), filled(m["job_key"]), filled(F.col("key"))).alias("job_key"), stamp.alias("written_at"), sample.alias("sample")
    ).where("job_idx is not null")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """A rollout log's records (`parse_checkpoints`), in envelope form or bare."""
    return parse_checkpoints(spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("file_time")))


def read_conversations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exported conversations, one JSON document a file: path, rescale (from its folder) and the fields; broken files keep their text in corrupt_record."""
    full = f"{schema}, corrupt_record string"
    rows = spark.read.schema(full).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "corrupt_record").json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "*").withColumn("rescale", rescale_of_path(F.col("path")))


def read_parquet_with_origin(spark: SparkSession, paths: Sequence[str], most: int | None = None) -> DataFrame:
    """Parquet files in the given order with file_no, file and row_index; the first `most` rows of that order if given (0 or less is an error), files named twice are."""
    if len(set(paths)) != len(paths):
        raise ValueError("a file is named twice")
    if most is not None and most <= 0:
        raise ValueError("the number of rows must be positive")
    parts = [spark.read.parquet(p).select("*", F.lit(i).alias("file_no"), F.lit(p).alias("file"), F.col("_metadata.row_index").alias("row_index")) for i, p in enumerate(paths)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows if most is None else rows.orderBy("file_no", "row_index").limit(most)


def count_rows(spark: SparkSession, path: str) -> int | None:
    """Rows of a parquet file from its footers; null if there is none."""
    return spark.read.parquet(path).count() if files.exists(spark, path) else None


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """An id per line, trimmed, blank ones dropped, distinct: id."""
    return spark.read.text(path).select(clean_text(F.col("value")).alias("id")).where("id <> ''").distinct()


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated values with a header, by schema, and the file's path."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("path"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """key=value files: folder, key, value; comments and lines without = are skipped, a repeated key keeps its last value, quotes around values go."""
    rows = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("folder"), "value", F.monotonically_increasing_id().alias("at"))
    parsed = rows.where(~F.col("value").rlike(r"^\s*#") & F.col("value").contains("=")).select(
        "folder", clean_text(F.regexp_extract("value", "^([^=]*)=", 1)).alias("key"), F.regexp_replace(clean_text(F.regexp_extract("value", "^[^=]*=(.*)$", 1)), "^[\"']|[\"']$", "").alias("value"), "at"
    )
    return parsed.groupBy("folder", "key").agg(F.max_by("value", "at").alias("value"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weights from `source: number` lines of a small YAML file, on the driver: source, weight. None, or a negative one, is an error."""
    found = [(m[1].strip("\"'"), float(m[2])) for line in Path(path).read_text().splitlines() if (m := re.match(r"^\s*([^\s#:][^:]*?)\s*:\s*([-+.\deE]+)\s*(?:#.*)?$", line))]
    if not found or min(w for _, w in found) < 0:
        raise ValueError("weights must be present and not negative")
    return spark.createDataFrame(found, "source string, weight double")


def read_keyed_object(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object keyed by id as rows: id and the fields of its values; no rows if there is no such file."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], "id string").select("id", F.from_json(F.lit("{}"), f"struct<{value_schema}>").alias("v")).select("id", "v.*")
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias("id", "v"))
    return entries.select("id", "v.*")


def read_pages(spark: SparkSession, root: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Page images of document folders, without reading their content: document, page, path; pages first <= page < last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(root).select("path", "length")
    pages = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("document"), page_of_path(F.col("path")).alias("page"), "path").where(F.col("page") >= first)
    return pages if last is None else pages.where(F.col("page") < last)


def missing_images(rows: DataFrame, pages: DataFrame, root: str, images: str = "images") -> DataFrame:
    """Image paths named by rows that aren't among the pages."""
    named = rows.select(F.explode(images).alias("image")).distinct().withColumn("path", F.concat(F.lit(f"file:{root.rstrip('/')}/"), F.col("image")))
    return named.join(pages.select("path"), "path", "left_anti").select("image")


def position(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds index, the row's place from 0 in a unique order: a range sort numbers each partition and adds the counts before it.

    Unlike a window without partitions this keeps the rows distributed; only one
    count per partition meets in a task. The sorted rows are checkpointed, so that
    both uses see the same partitions.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    sorted_rows = rows.orderBy(*order).checkpoint().withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    first = sorted_rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = first.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return sorted_rows.join(F.broadcast(before.drop("_n")), "_p").withColumn("index", F.col("_before") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_before")
