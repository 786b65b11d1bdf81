"""Deeply nested JSON records as flat related tables.

One depth-first visitor walks each record once and emits, for every table of a
specification, rows tagged with the table's name and carrying a primary key, the
parent's key and the element as JSON. The tagged stream is written partitioned
by tag, and a schema is applied to each tag when it is read back.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChildTable:
    """An array inside its parent's element.

    `path` leads from the parent's value to the array. With `self_link`, a pair
    (own id field, parent id field), elements of the array name their parent
    among its other elements. Every
    step of a path decodes JSON text.
    """

    tag: str
    path: tuple[str, ...]
    children: tuple[ChildTable, ...] = field(default=())
    self_link: tuple[str, str] | None = None


TAGGED = "tag string, pk string, parent_pk string, parent_no int, child_no int, body string"


def decode(value: object) -> object:
    """JSON text in place of a value as that value, however often it was wrapped; other values as they are."""
    while isinstance(value, str):
        head = value.lstrip()[:1]
        if head == "n" and value.strip() == "null":
            return None
        if head not in ("{", "[", '"'):
            return value
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def as_number(value: object) -> float | None:
    """A number, or a number written as text; else null. Booleans aren't numbers."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    try:
        return float(value) if isinstance(value, str) else None
    except ValueError:
        return None


def _items(value: object, path: Sequence[str]) -> list:
    """The elements at the path's end; one object counts as a list of one, anything else as none."""
    value = decode(value)
    for step in path:
        value = decode(value.get(step)) if isinstance(value, dict) else None
    if isinstance(value, list):
        return [decode(v) for v in value]
    return [value] if isinstance(value, dict) else []


def without(value: object, paths: Sequence[Sequence[str]]) -> object:
    """A record without what lies at the ends of the paths, JSON text on the way decoded."""
    if not isinstance(value, dict):
        return value
    gone = {p[0] for p in paths if len(p) == 1}
    out = {k: v for k, v in value.items() if k not in gone}
    for step in {p[0] for p in paths if len(p) > 1 and p[0] in out}:
        out[step] = without(decode(out[step]), [p[1:] for p in paths if p[0] == step and len(p) > 1])
    return out


Emit = Callable[[str, str, str, int, int, object], None]


def visit(value: object, tables: Sequence[ChildTable], key: str, number: int, emit: Emit) -> None:
    """Depth first: emits every element of `tables` below `value`, each before its own children."""
    for table in tables:
        items = _items(value, table.path)
        places: dict[float, int] = {}
        if table.self_link:
            for i, item in enumerate(items):
                own = as_number(item.get(table.self_link[0])) if isinstance(item, dict) else None
                if own is not None:
                    places.setdefault(own, i)
        for i, item in enumerate(items):
            if item is None:
                continue
            pk, parent_pk, parent_no = f"{key}/{table.tag}:{i}", key, number
            if table.self_link:
                named = as_number(item.get(table.self_link[1])) if isinstance(item, dict) else None
                parent_no = places.get(named, -1) if named is not None else -1
                parent_pk = f"{key}/{table.tag}:{parent_no}" if parent_no >= 0 else key
            emit(table.tag, pk, parent_pk, parent_no, i, item)
            if table.children:
                visit(item, table.children, pk, i, emit)


def shred(records: DataFrame, tables: Sequence[ChildTable], id_column: str, json_column: str, *, root: str | None = None, body: bool = True) -> DataFrame:
    """Tagged rows of all tables, in a single pass over the records.

    Result: `id_column` as it was, then tag, pk (unique in all tables if the ids
    are: the id and the places on the way, '' for a null id), parent_pk, parent_no,
    child_no and body (the element as JSON text). child_no is the place in the array from
    0, null elements counted but not emitted; parent_no the parent's place, -1
    where the parent is the record itself or isn't found (of several elements
    with the named id the first is the parent). With `root`, each readable
    record is also a row of that tag, its body without the arrays of `tables`, which
    have rows of their own.
    `body=False` leaves the body null, which saves encoding it.

    Null, empty and unreadable records, and those that aren't an object, give no
    rows. Records that occur twice are shredded twice. No shuffle; memory is
    that of one Arrow batch.
    """
    id_type = records.schema[id_column].dataType
    flat = records.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{json_column}`").alias("_json"))
    encode = (lambda v: json.dumps(v, ensure_ascii=False)) if body else (lambda v: None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources: list[int] = []
            rows: list[tuple] = []
            for i, (own, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                key, record = "" if own is None else str(own), decode(text)
                if not isinstance(record, dict):
                    continue

                def emit(*row: object, i: int = i) -> None:
                    sources.append(i)
                    rows.append((*row[:5], encode(row[5])))

                if root:
                    emit(root, key, None, -1, 0, without(record, [t.path for t in tables]))
                visit(record, tables, key, -1, emit)
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sources, pa.int64())), *arrays], ["_id", "tag", "pk", "parent_pk", "parent_no", "child_no", "body"])

    out = flat.mapInArrow(run, f"_id {id_type.simpleString()}, {TAGGED}")
    return out.withColumnRenamed("_id", id_column)


def write_tagged(tagged: DataFrame, path: str) -> None:
    """Writes the tagged rows partitioned by tag; one pass fills every table."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One table of a tagged store, its body read by `schema` (DDL); only that tag's files are read.

    Fields the schema doesn't name stay in `body`; fields that don't fit are null.
    """
    rows = spark.read.parquet(path).where(F.col("tag") == tag)
    return apply_schema(rows, schema)


def apply_schema(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of one tag with the fields of `schema` (DDL) read from their body, clashing names prefixed with body_."""
    taken = set(rows.columns)
    parsed = rows.withColumn("_parsed", F.from_json("body", schema))
    names = parsed.schema["_parsed"].dataType.names
    return parsed.select(
        *[F.col(c) for c in rows.columns if c != "tag"],
        *[F.col("_parsed")[n].alias(f"body_{n}" if n in taken else n) for n in names],
    )


def link_report(tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Per table: n_rows, n_keys (distinct pk), n_typed (rows of which some field was read) and n_linked (rows whose parent is in one of the tables, or that need none)."""
    out = []
    for tag, rows in tables.items():
        read = [c for c in rows.columns if c not in ("pk", "parent_pk", "parent_no", "child_no", "body")][1:]
        typed = F.greatest(F.lit(0), F.lit(0), *[F.col(f"`{c}`").isNotNull().cast("int") for c in read])
        out.append(rows.select(F.lit(tag).alias("tag"), "pk", "parent_pk", typed.alias("typed")))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    keys = every.select(F.col("pk").alias("_pk")).distinct()
    joined = every.join(keys, F.col("parent_pk") == F.col("_pk"), "left")
    linked = F.col("_pk").isNotNull() | (F.col("tag") == root)
    return joined.groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pk").alias("n_keys"), F.sum("typed").cast("bigint").alias("n_typed"), F.count(F.when(linked, 1)).alias("n_linked"))


# Fields of an object that is a box, at any depth.
BOX_FIELDS = ("left", "top", "width", "height", "page")


def boxes_within(value: object) -> Iterator[tuple[int, list[float]]]:
    """Page and [x1, y1, x2, y2] of every object with the box fields and a positive extent, depth first, however deep."""
    stack = [value]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            numbers = [as_number(item.get(f)) for f in BOX_FIELDS]
            if all(n is not None and n == n and abs(n) != float("inf") for n in numbers):
                left, top, width, height, page = numbers
                if width > 0 and height > 0:
                    yield int(page), [left, top, left + width, top + height]
            stack.extend(reversed(list(item.values())))
        elif isinstance(item, list):
            stack.extend(reversed(item))


def harvest_boxes(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """One row per box found anywhere in a record's JSON: `id_column`, page, box. Null and unreadable records give none."""
    id_type = records.schema[id_column].dataType.simpleString()
    flat = records.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{json_column}`").alias("_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, page, box) for i, text in enumerate(batch.column(1).to_pylist()) for page, box in boxes_within(decode(text))]
            sources, pages, boxes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sources, pa.int64())), pa.array(pages, pa.int32()), pa.array(boxes, pa.list_(pa.float64()))], ["_id", "page", "box"])

    return flat.mapInArrow(run, f"_id {id_type}, page int, box array<double>").withColumnRenamed("_id", id_column)
