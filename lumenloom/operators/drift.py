"""Schemas that drift between files: rescue-column ingestion and a change report.

Lines of JSON are read into one fixed target schema. Whatever the target does
not name, and whatever cannot be held by the target's type without loss, stays
in a rescue column as JSON text, so nothing that was readable is dropped.
Fields can later be approved (`promote`) and rescued values replayed into typed
columns, and `change_report` tells file by file what appeared, vanished, was
renamed or changed its type.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions.values import bound
from lumenloom.session import written

#: Strict JSON: what a standard parser would refuse is unreadable here, too.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}

RESCUED = "_rescued"


def parse_objects(lines: DataFrame, line: str, keep: Sequence[Column]) -> DataFrame:
    """`keep` plus `_fields map<string,variant>`, one row per line that is exactly one JSON object.

    Wrapping the line in brackets makes trailing text or a second object a
    parse error (or a second element), which plain `from_json` would ignore.
    The generator also keeps Catalyst from repeating the parse for every field.
    """
    parsed = F.from_json(F.concat(F.lit("["), F.col(f"`{line}`"), F.lit("]")), "array<map<string,variant>>", _STRICT)
    single = F.transform(F.array(parsed), lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0))))
    return lines.select(*keep, F.explode(single).alias("_fields")).where(F.col("_fields").isNotNull())


def as_json(value: Column) -> Column:
    """JSON text of a variant; the text null for JSON null."""
    return F.coalesce(F.to_json(value), F.lit("null"))


def json_kind(text: Column) -> Column:
    """JSON type of a value given as JSON text; null for JSON null."""
    head = F.substring(text, 1, 1)
    return (
        F.when(head == '"', F.lit("string"))
        .when(head == "[", F.lit("array"))
        .when(head == "{", F.lit("object"))
        .when(head.isin("t", "f"), F.lit("boolean"))
        .when(head != "n", F.lit("number"))
    )


def _text(value: Column) -> Column:
    """A string variant's content; other variants as their JSON text; null for JSON null."""
    return F.try_variant_get(value, "$", "string")


#: What `schema_of_variant` calls JSON's types.
_NUMBER, _NULL = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)", "VOID"


def _exact(value: Column, kind: str) -> Column:
    """The variant as Spark type `kind` if it already has that JSON type, else null."""
    schema = F.schema_of_variant(value)
    if kind.startswith("array<"):
        items = F.try_variant_get(value, "$", "array<variant>")
        typed = F.transform(items, lambda v: _exact(v, kind[6:-1]))
        lost = F.exists(F.zip_with(items, typed, lambda v, t: t.isNull() & (F.schema_of_variant(v) != _NULL)), lambda bad: bad)
        return F.when(schema.startswith("ARRAY") & ~lost, typed)
    if kind in ("string", "boolean"):
        fits = schema == kind.upper()
    elif kind in ("int", "bigint", "smallint", "tinyint"):
        fits = schema.rlike(_NUMBER) & F.to_json(value).rlike(r"^-?\d+$")
    else:
        fits = schema.rlike(_NUMBER)
    return F.when(fits, F.try_variant_get(value, "$", kind))


def _lenient(value: Column, kind: str) -> Column:
    """As `_exact`, and also numbers and booleans written as text, scalars read as text, one value in place of an array."""
    if kind.startswith("array<"):
        single = F.when(~F.schema_of_variant(value).rlike("^(ARRAY|OBJECT|VOID)"), F.array(_lenient(value, kind[6:-1])))
        return F.coalesce(_exact(value, kind), F.when(F.get(single, F.lit(0)).isNotNull(), single))
    if kind == "string":
        return _text(value)
    number = F.regexp_replace(_text(value), r"^\s+|\s+$", "")
    if kind in ("int", "bigint", "smallint", "tinyint"):
        number = F.regexp_replace(number, r"\.0+$", "")
    return F.coalesce(_exact(value, kind), number.try_cast(kind))


def rescue_ingest(lines: DataFrame, target: Mapping[str, str], line: str = "line") -> DataFrame:
    """Lines of JSON as typed columns plus a rescue column.

    Result: the columns of `lines` without `line`, one column per field of
    `target` (name to Spark type), and `_rescued map<string,string>` with every
    other field, every value that is not exactly of the target's type, and every
    explicit null, each as JSON text. A field absent from the line is null in
    its column and missing from `_rescued`, so presence is never lost.

    Empty, null and unreadable lines, and lines that are not one JSON object,
    give no row (`unreadable_lines` counts them). A carried column that bears
    the name of a target field is kept as `_file_<name>`. A repeated key keeps
    its last value. An empty table gives an empty table.
    """
    kept = [F.col(f"`{c}`").alias(f"_file_{c}" if c in target or c == RESCUED else c) for c in lines.columns if c != line]
    fields = parse_objects(lines, line, kept)
    typed = {name: _exact(F.col("_fields")[name], kind) for name, kind in target.items()}
    held = F.array_compact(F.array(*[F.when(value.isNotNull(), F.lit(name)) for name, value in typed.items()], F.lit(None).cast("string")))
    carried = [c for c in fields.columns if c != "_fields"]
    # The array of one binds `held` to a variable, so that it is not worked out anew for every key.
    rescued = F.transform(F.array(held), lambda h: F.transform_values(F.map_filter("_fields", lambda k, _: ~F.array_contains(h, k)), lambda _, v: as_json(v)))[0]
    return fields.select(*[F.col(f"`{c}`") for c in carried], *[value.alias(name) for name, value in typed.items()], rescued.alias(RESCUED))


def unreadable_lines(lines: DataFrame, by: Sequence[str] = ("feed", "file_name"), line: str = "line") -> DataFrame:
    """Per file: all lines, and how many of them are not one JSON object (null and empty ones included)."""
    keys = [F.col(c) for c in by]
    readable = parse_objects(lines, line, keys).groupBy(*by).agg(F.count(F.lit(1)).alias("n_readable"))
    total = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"))
    same = [total[c].eqNullSafe(readable[c]) for c in by]
    return total.join(readable, same, "left").select(*[total[c] for c in by], "n_lines", (F.col("n_lines") - F.coalesce("n_readable", F.lit(0))).alias("n_unreadable"))


def promote(ingested: DataFrame, approved: Mapping[str, str], sources: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Approve fields: replay rescued values into typed columns.

    `approved` maps a column to its type; `sources` maps it to the field names
    it may have had, its own name always included and tried first. A value
    already typed wins; else the first rescued one that can be read leniently
    (text holding a number, one value in place of an array). Replayed entries
    and explicit nulls of those fields leave `_rescued`; what still cannot be
    read stays there.
    """
    columns: dict[str, Column] = {}
    spent_of: list[tuple[list[str], str]] = []
    for name, kind in approved.items():
        tried = list(dict.fromkeys([name, *(sources or {}).get(name, ())]))
        values = [_lenient(F.try_parse_json(F.col(RESCUED)[field]), kind) for field in tried]
        own = [F.col(f"`{name}`")] if name in ingested.columns else []
        columns[name] = F.coalesce(*own, *values)
        spent_of.append((tried, kind))

    def left_over(key: Column, text: Column) -> Column:
        spent = F.lit(False)
        for tried, kind in spent_of:
            spent = spent | (key.isin(tried) & ((text == "null") | _lenient(F.try_parse_json(text), kind).isNotNull()))
        return ~spent

    return ingested.withColumns({**columns, RESCUED: F.map_filter(RESCUED, left_over)})


def comparable(text: Column) -> Column:
    """A value's JSON text reduced to its scalars, so that it compares equal across JSON types; hashed to 64 bits.

    5, "5", [5] and "[5]" become the same, as do an object and the list of its
    values. Null and empty values become null.
    """
    keyless = F.when(text.contains('":') | text.contains('" '), F.regexp_replace(text, r'\\*"[^"\\]*\\*"\s*:', " ")).otherwise(text)
    bare = F.translate(keyless, '[]{}"\\,\t\n\r', " " * 10)

    def hashed(plain: Column) -> Column:
        number = F.when(F.substring(plain, 1, 1).isin(*"-0123456789") & plain.rlike(r"^-?[0-9][0-9.e+-]*$"), plain.try_cast("double"))
        return F.when(~plain.isin("", "null"), F.xxhash64(F.coalesce(number.cast("string"), plain)))

    single = bound(bare, lambda b: F.when(b.contains("  "), F.regexp_replace(b, " +", " ")).otherwise(b))
    return bound(F.lower(F.trim(single)), hashed)


def present_fields(ingested: DataFrame, target: Mapping[str, str], record_key: Sequence[str]) -> DataFrame:
    """The fields that each record has, from the typed columns and the rescue column alike, one row per record.

    Columns: feed, file_name, record (hash of the key, null if part of it is),
    fields array of (field, kind (JSON type, null for null), v (`comparable` value)).
    """
    own = lambda c: F.col(f"_file_{c}" if f"_file_{c}" in ingested.columns else c)
    typed = [F.when(F.col(f"`{name}`").isNotNull(), F.struct(F.lit(name).alias("key"), F.to_json(F.col(f"`{name}`").cast("variant")).alias("value"))) for name in target]
    known = F.lit(True)
    for part in record_key:
        known = known & F.col(part).isNotNull()
    entries = F.concat(F.map_entries(RESCUED), F.array_compact(F.array(*typed))) if target else F.map_entries(RESCUED)
    fields = F.transform(entries, lambda e: F.struct(e["key"].alias("field"), json_kind(e["value"]).alias("kind"), comparable(e["value"]).alias("v")))
    return ingested.where(own("file_name").isNotNull()).select(F.coalesce(own("feed"), F.lit("")).alias("feed"), own("file_name").alias("file_name"), F.when(known, F.xxhash64(*record_key)).alias("record"), fields.alias("fields"))


def file_order(lines: DataFrame) -> DataFrame:
    """feed ('' for null), file_name, n, n_files: the files of each feed numbered from 1 by `exported_at`, ties by name."""
    return (
        lines.where(F.col("file_name").isNotNull())
        .groupBy(F.coalesce("feed", F.lit("")).alias("feed"), "file_name")
        .agg(F.min("exported_at").alias("at"))
        .withColumn("n", F.row_number().over(Window.partitionBy("feed").orderBy("at", "file_name")))
        .withColumn("n_files", F.count(F.lit(1)).over(Window.partitionBy("feed")))
        .drop("at")
    )


def change_report(
    lines: DataFrame,
    target: Mapping[str, str],
    record_key: Sequence[str] = ("document_id", "question"),
    least_agreement: float = 0.8,
) -> DataFrame:
    """Every change of fields between a file and the one before it in its feed.

    Result: feed, file_name, n (the file's number in its feed), change,
    old_field, new_field ('' for none), where change is renamed, removed, added
    or type_changed. Lines belong to their file whenever they were received;
    files are ordered by `exported_at`, ties by name. A field is present if a
    line has its key, even with null. A field that vanishes and one that appears
    are one renamed field if, of the records (`record_key`) listed in both files
    with a value in either, at least `least_agreement` keep it; if several fields
    fit, the one with most agreeing records is taken, then the higher agreement,
    then the names in order.

    Lines without a file name, unreadable ones and repeated ones change nothing;
    null feeds are one feed; a feed of one file, like an empty table, gives no row.

    Lines are parsed once; what the records have is written by column to the
    checkpoint folder. Presence and types are pre-aggregated per file and field.
    The fields that vanish from or appear in a file then meet its records as one
    row per file, so a record is shuffled once, and only its turning fields go on
    to the comparison, whose groups hold one record's fields.
    """
    ingested = rescue_ingest(lines.select("feed", "file_name", "exported_at", "line"), target)
    records = written(present_fields(ingested, target, record_key))
    files = written(file_order(lines))
    step = Window.partitionBy("feed", "field").orderBy("n")
    around = written(
        records.select("feed", "file_name", F.inline("fields"))
        .groupBy("feed", "file_name", "field")
        .agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
        .join(files, ["feed", "file_name"])
        .withColumns({"before": F.lag("n").over(step), "after": F.lead("n").over(step), "old_kinds": F.lag("kinds").over(step)})
        .select(
            "feed", "file_name", "n", "field", "kinds", "old_kinds",
            ((F.col("n") > 1) & ~F.coalesce(F.col("before") == F.col("n") - 1, F.lit(False))).alias("new"),
            ((F.col("n") < F.col("n_files")) & ~F.coalesce(F.col("after") == F.col("n") + 1, F.lit(False))).alias("ends"),
            F.coalesce(F.col("before") == F.col("n") - 1, F.lit(False)).alias("stays"),
        )
    )
    appeared = around.where("new").select("feed", "n", F.col("field").alias("new_field"), "kinds")
    vanished = around.where("ends").select("feed", (F.col("n") + 1).alias("n"), F.col("field").alias("old_field"), F.col("kinds").alias("old_kinds"))

    # One row per file: the fields that end with it and those that are new in it.
    named = lambda flag: F.collect_list(F.when(F.col(flag), F.col("field")))
    turning = around.where("new or ends").groupBy("feed", "file_name", "n").agg(named("ends").alias("old"), named("new").alias("new"))
    role = lambda names, shift, what: F.when(F.size(names) > 0, F.struct(F.lit(what).alias("role"), (F.col("n") + shift).alias("n"), F.filter("fields", lambda f: F.array_contains(names, f["field"])).alias("f")))
    side = lambda what: F.collect_list(F.when(F.col("role") == what, F.struct("field", "v")))
    met = (
        records.where(F.col("record").isNotNull())
        .join(turning, ["feed", "file_name"])
        .select("feed", "record", F.inline(F.array_compact(F.array(role(F.col("old"), 1, "old"), role(F.col("new"), 0, "new")))))
        .select("feed", "record", "role", "n", F.explode("f").alias("f"))
        .select("feed", "record", "role", "n", "f.field", "f.v")
        .groupBy("feed", "n", "record", "role", "field")
        .agg(F.max("v").alias("v"))
        .groupBy("feed", "n", "record")
        .agg(side("old").alias("o"), side("new").alias("w"))
        .select("feed", "n", "w", F.explode("o").alias("o"))
        .select("feed", "n", "o", F.explode("w").alias("w"))
        .select("feed", "n", F.col("o.field").alias("old_field"), F.col("w.field").alias("new_field"), F.col("o.v").alias("old_v"), F.col("w.v").alias("v"))
    )
    votes = (
        met.where(F.col("old_v").isNotNull() | F.col("v").isNotNull())
        .groupBy("feed", "n", "old_field", "new_field")
        .agg(F.count(F.lit(1)).alias("both"), F.count(F.when(F.col("old_v") == F.col("v"), 1)).alias("same"))
        .where((F.col("same") > 0) & (F.col("same") >= least_agreement * F.col("both")))
    )
    rank = lambda side: Window.partitionBy("feed", "n", side).orderBy(F.desc("same"), F.desc(F.col("same") / F.col("both")), "old_field", "new_field")
    renamed = votes.withColumns({"a": F.row_number().over(rank("old_field")), "b": F.row_number().over(rank("new_field"))}).where("a = 1 and b = 1").select("feed", "n", "old_field", "new_field")

    changes = (
        vanished.join(renamed, ["feed", "n", "old_field"], "left")
        .join(appeared, ["feed", "n", "new_field"], "full_outer")
        .unionByName(
            around.where("stays").select("feed", "n", F.col("field").alias("old_field"), F.col("field").alias("new_field"), "old_kinds", "kinds")
        )
    )
    both = F.col("old_field").isNotNull() & F.col("new_field").isNotNull()
    differs = both & (F.size("old_kinds") > 0) & (F.size("kinds") > 0) & (F.col("old_kinds") != F.col("kinds"))
    what = F.array_compact(
        F.array(
            F.when(F.col("new_field").isNull(), F.lit("removed")).when(F.col("old_field").isNull(), F.lit("added")).when(F.col("old_field") != F.col("new_field"), F.lit("renamed")),
            F.when(differs, F.lit("type_changed")),
        )
    )
    none = F.lit("")
    return (
        changes.select("feed", "n", F.coalesce("old_field", none).alias("old_field"), F.coalesce("new_field", none).alias("new_field"), F.explode(what).alias("change"))
        .join(files.select("feed", "n", "file_name"), ["feed", "n"])
        .select("feed", "file_name", "n", "change", "old_field", "new_field")
    )


def learn_aliases(report: DataFrame, target: Mapping[str, str], most_names: int = 10_000) -> dict[str, list[str]]:
    """For each target field the other names it has had, from the renames of a `change_report`.

    Names are joined to the target they are most often renamed from or to, in
    rounds, so chains of renames count; ties go to the alphabetically first. The
    collected table has one row per pair of field names; more than `most_names`
    rows (data used as field names) raise an error instead of flooding the driver.
    """
    pairs = report.where("change = 'renamed'").groupBy("old_field", "new_field").agg(F.count(F.lit(1)).alias("n")).limit(most_names + 1).collect()
    if len(pairs) > most_names:
        raise ValueError(f"more than {most_names} renamed pairs: field names look like data")
    home = {name: name for name in target}
    while True:
        votes: dict[str, dict[str, int]] = {}
        for old, new, n in pairs:
            for known, name in ((old, new), (new, old)):
                if known in home and name not in home:
                    tally = votes.setdefault(name, {})
                    tally[home[known]] = tally.get(home[known], 0) + n
        if not votes:
            break
        for name, tally in sorted(votes.items()):
            home[name] = min(tally, key=lambda t: (-tally[t], t))
    aliases: dict[str, list[str]] = {name: [] for name in target}
    for name, where in sorted(home.items()):
        if name != where:
            aliases[where].append(name)
    return aliases


def feed_aliases(report: DataFrame, files: DataFrame, target: Mapping[str, str], anywhere: Mapping[str, Sequence[str]]) -> DataFrame:
    """feed, file_name, aliases (map of a field's name in that file to the target field it is), for the files that have one.

    The renames of a feed are chained in the order of its files; a chain through
    a target's name is that target, in each file under the name it had there. A
    chain without one takes the target that its names have `anywhere`
    (`learn_aliases`). So a name that means different things in different feeds,
    or at different times, is read as what it was there.
    """
    renames = report.where("change = 'renamed'").select("feed", "n", "old_field", "new_field")
    elsewhere = {name: t for t, names in anywhere.items() for name in names}
    known = set(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed: str | None = None
        chains: list[list[list]] = []  # of [name, first file, last file]
        live: dict[str, int] = {}
        ended: dict[str, int] = {}  # the last file in which a name was another chain's

        def out() -> pa.RecordBatch:
            rows = []
            for chain in chains:
                means = next((name for name, _, _ in chain if name in known), None) or next((elsewhere[name] for name, _, _ in chain if name in elsewhere), None)
                rows += [(feed, name, low, high, means) for name, low, high in chain if means is not None and name != means]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["feed", "name", "low", "high", "target"])

        for batch in batches:
            for own, n, old, new in zip(*(c.to_pylist() for c in batch.columns)):
                if own != feed:
                    if feed is not None:
                        yield out()
                    feed, chains, live, ended = own, [], {}, {}
                at = live.pop(old, None)
                if at is None:
                    at = len(chains)
                    chains.append([[old, ended.get(old, 0) + 1, 2**31 - 1]])
                chains[at][-1][2] = ended[old] = n - 1
                if new in live:  # its field had vanished before
                    chains[live[new]][-1][2] = n - 1
                chains[at].append([new, n, 2**31 - 1])
                live[new] = at
        if feed is not None:
            yield out()

    spans = renames.repartition("feed").sortWithinPartitions("feed", "n", "old_field").mapInArrow(run, "feed string, name string, low int, high int, target string")
    most = files.groupBy("feed").agg(F.max("n").alias("most"))
    each = spans.join(most, "feed").select("feed", "name", "target", F.explode(F.sequence(F.col("low"), F.least("high", "most"))).alias("n"))
    one = each.groupBy("feed", "n", "name").agg(F.min("target").alias("target"))  # a name renamed away and back within a file's step
    return one.join(files.select("feed", "file_name", "n"), ["feed", "n"]).groupBy("feed", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("name", "target"))).alias("aliases"))


def promote_by(ingested: DataFrame, approved: Mapping[str, str], aliases: str, fallback: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """As `promote`, but what a field was called comes with each row, in the map `aliases` (name to approved field, dropped afterwards).

    A value already typed wins, then the field's own name in the rescue column,
    then the name the map gives, then the names of `fallback` that the map
    doesn't give to another field.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    said = F.coalesce(F.col(aliases), empty)
    other = {name: t for t, names in (fallback or {}).items() for name in names}
    spare = F.create_map(*[F.lit(x) for pair in other.items() for x in pair]) if other else empty
    means = lambda key: F.coalesce(said[key], F.when(key.isin(*approved), key), spare[key])
    order = lambda key: F.when(key.isin(*approved), F.lit(0)).when(F.map_contains_key(said, key), F.lit(1)).otherwise(F.lit(2))
    # (target, order, name, text) of every rescued value that is some approved field's.
    tagged = F.transform(F.map_entries(RESCUED), lambda e: F.struct(means(e["key"]).alias("t"), order(e["key"]).alias("o"), e["key"].alias("k"), e["value"].alias("v")))
    rows = ingested.withColumn("_told", F.array_sort(F.filter(tagged, lambda x: x["t"].isNotNull())))

    def read(name: str, kind: str) -> Column:
        values = F.transform(F.filter("_told", lambda x: x["t"] == name), lambda x: bound(F.try_parse_json(x["v"]), lambda v: _lenient(v, kind)))
        first = F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))
        return F.coalesce(F.col(f"`{name}`"), first) if name in ingested.columns else first

    def spent(x: Column) -> Column:
        done = x["v"] == "null"
        for name, kind in approved.items():
            done = done | ((x["t"] == name) & bound(F.try_parse_json(x["v"]), lambda v: _lenient(v, kind).isNotNull()))
        return done

    gone = F.transform(F.filter("_told", spent), lambda x: x["k"])
    left = F.transform(F.array(gone), lambda names: F.map_filter(RESCUED, lambda key, _: ~F.array_contains(names, key)))[0]
    return rows.withColumns({**{name: read(name, kind) for name, kind in approved.items()}, RESCUED: left}).drop("_told", aliases)


def consistent_table(lines: DataFrame, target: Mapping[str, str], record_key: Sequence[str] = ("document_id", "question")) -> DataFrame:
    """All readable records of all files in one table of the target schema.

    Renames found by `change_report` approve the fields: rescued values are
    replayed into the target's columns under the name they had in their file
    (`feed_aliases`), and, for names no rename of the feed explains, under those
    the field has elsewhere. Fields the target doesn't know stay in `_rescued`.
    Carries every column of `lines` but `line`. Lines without a file name are
    read by the names known elsewhere.
    """
    key_types = {name: target[name] for name in record_key}
    report = written(change_report(lines, key_types, record_key))
    anywhere = learn_aliases(report, target)
    aliases = feed_aliases(report, file_order(lines), target, anywhere).select(F.col("feed").alias("_feed"), F.col("file_name").alias("_name"), F.col("aliases").alias("_aliases"))
    told = lines.join(aliases, F.coalesce(lines["feed"], F.lit("")).eqNullSafe(F.col("_feed")) & (lines["file_name"] == F.col("_name")), "left").drop("_feed", "_name")
    return promote_by(rescue_ingest(told, target), target, "_aliases", anywhere)
