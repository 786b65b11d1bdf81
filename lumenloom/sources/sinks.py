"""Sinks: parquet, JSONL, delimited text, partitioned tables, id lists and small reports."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lumenloom.sources import files


def write_splits(rows: DataFrame, path: str, part: str = "part") -> None:
    """One parquet folder per split, in one pass over the rows."""
    rows.write.mode("overwrite").partitionBy(part).parquet(path)


def write_jsonl(rows: DataFrame, path: str, stamp: str | None = None) -> None:
    """Lines of JSON, put in place by Spark's commit protocol as a whole; with `stamp`, a column of that name tells the time of writing."""
    out = rows.withColumn(stamp, F.current_timestamp()) if stamp else rows
    out.write.mode("overwrite").json(path)


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for delimited files."""
    nested = (ArrayType, MapType, StructType)
    return rows.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in rows.schema.fields])


def write_delimited(rows: DataFrame, path: str, sep: str = ",", columns: Sequence[str] | None = None) -> None:
    """CSV or TSV with a header; columns as given, else in alphabetical order."""
    flat(rows).select(*(columns or sorted(rows.columns))).write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def write_partitioned(rows: DataFrame, path: str, by: str, kind: str = "json") -> None:
    """A folder per value of a column."""
    (flat(rows) if kind == "csv" else rows).write.mode("overwrite").partitionBy(by).format(kind).option("header", True).save(path)


def write_ids(rows: DataFrame, column: str, path: str) -> None:
    """Distinct ids of a column in order, one a line; nulls are left out."""
    rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def collect_bounded(rows: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a small result; more than `most` are an error, not a flood of the driver."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    return [r.asDict(recursive=True) for r in found]


def write_json_report(rows: DataFrame, path: str) -> None:
    """A small result as one JSON file, replaced at once."""
    files.put_text(rows.sparkSession, path, json.dumps(json_values(collect_bounded(rows)), indent=2, default=str, ensure_ascii=False))


def write_bundle(tables: Mapping[str, DataFrame], folder: str) -> dict[str, int]:
    """Small tables side by side, each as <name>.tsv (columns in their order) and <name>.json; returns the rows of each."""
    counts = {}
    for name, rows in tables.items():
        found = collect_bounded(rows)
        text = lambda v: "" if v is None else json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (list, dict)) else str(v)
        lines = ["\t".join(rows.columns), *("\t".join(text(r[c]) for c in rows.columns) for r in found)]
        for suffix, body in (("tsv", "\n".join(lines) + "\n"), ("json", json.dumps(json_values(found), indent=2, default=str, ensure_ascii=False))):
            files.put_text(rows.sparkSession, f"{folder}/{name}.{suffix}", body)
        counts[name] = len(found)
    return counts


def json_values(value: object) -> object:
    """A value for JSON, however deep: numbers that aren't finite as null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: json_values(v) for k, v in value.items()}
    return [json_values(v) for v in value] if isinstance(value, (list, tuple)) else value


def percent(value: Column) -> Column:
    """0.1234 as 12.34%; n/a for null."""
    return F.coalesce(F.format_string("%.2f%%", value * 100), F.lit("n/a")) if value is not None else F.lit("n/a")


def number(value: Column) -> Column:
    """One decimal from 100 on, four below; n/a for null."""
    return F.when(value.isNull(), "n/a").when(F.abs(value) >= 100, F.format_string("%.1f", value)).otherwise(F.format_string("%.4f", value))


def write_markdown(rows: DataFrame, path: str, title: str) -> None:
    """A small result as a Markdown table."""
    found = collect_bounded(rows)
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in rows.columns) + " |" for r in found]
    files.put_text(rows.sparkSession, path, "\n".join(lines) + "\n")


def content_addressed(rows: DataFrame, content: str, name: str) -> DataFrame:
    """Distinct contents under a name made of their SHA-1 and the cleaned file name: target, content. Of equal contents the alphabetically first name is used."""
    digest = F.sha1(F.col(content))
    clean = F.substring(F.regexp_replace(F.col(name), r"[^A-Za-z0-9._-]+", "_"), 1, 96)
    return rows.groupBy(digest.alias("digest")).agg(F.min(clean).alias("stem"), F.first(content).alias(content)).select(F.concat(F.substring("digest", 1, 16), F.lit("_"), F.col("stem")).alias("target"), content)
