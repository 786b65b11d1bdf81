"""Queries of the column functions and of readers and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import budget as B
from lumenloom.functions import geometry as G
from lumenloom.functions import rescale as R
from lumenloom.functions import samples as S
from lumenloom.functions import text as T
from lumenloom.functions import values as V
from lumenloom.operators import conversations, datasets, identity, logs, records, summary
from lumenloom.plans.evaluation import CROPS, SAMPLES, crops, rounded, samples
from lumenloom.plans.registry import Registry, table
from lumenloom.plans.trajectories import plain
from lumenloom.session import scratch
from lumenloom.sources import readers, sinks

REGISTRY = Registry()


def _joined(box) -> object:
    """A box as text, whole numbers without fraction."""
    return F.array_join(F.transform(box, lambda v: v.cast("bigint").cast("string")), ",")


def _clamp_sql(x1: str, y1: str, x2: str, y2: str, w: str, h: str) -> str:
    cut = [f"greatest(0, least({w}, {x1}))", f"greatest(0, least({h}, {y1}))", f"greatest(0, least({w}, {x2}))", f"greatest(0, least({h}, {y2}))"]
    text = " || ',' || ".join(f"CAST(CAST({c} AS BIGINT) AS VARCHAR)" for c in cut)
    return f"CASE WHEN {cut[0]} < {cut[2]} AND {cut[1]} < {cut[3]} THEN {text} END"


def _even(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


@REGISTRY.add(
    "box_geometry",
    sql=f"""WITH {CROPS}, p AS (SELECT *, trunc(x1) AS a, trunc(y1) AS b, trunc(x2) AS c, trunc(y2) AS d FROM crops) SELECT conv, step, {_clamp_sql("a", "b", "c", "d", "40", "30")} AS in_pixels,
      {_clamp_sql(_even("x1 * 640 / 1000.0"), _even("y1 * 480 / 1000.0"), _even("x2 * 640 / 1000.0"), _even("y2 * 480 / 1000.0"), "640", "480")} AS from_thousandths,
      {" || ',' || ".join(f"CAST({_even(f'{o} + {v} * ({s} / {n}.0)')} AS VARCHAR)" for o, v, s, n in (("x1", 3, "(x2 - x1)", 50), ("y1", 4, "(y2 - y1)", 25), ("x1", 30, "(x2 - x1)", 50), ("y1", 20, "(y2 - y1)", 25)))} AS translated,
      abs(x1 - round_even(x1, 0)) <= 1 AND abs(y1 - round_even(y2, 0)) <= 1 AS near FROM p""",
)
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes clamped to an image, taken from thousandths, moved from a crop to its original, and compared with a tolerance."""
    box = F.col("box")
    inner = F.array(*[F.lit(float(v)) for v in (3, 4, 30, 20)])
    near = G.within_tolerance(F.array(box[0], box[1]), F.array(F.bround(box[0]), F.bround(box[3])))
    return crops(spark, sf_dir).select(
        "conv", "step", _joined(G.clamp_to_pixels(box, F.lit(40.0), F.lit(30.0))).alias("in_pixels"), _joined(G.from_thousandths(box, F.lit(640), F.lit(480))).alias("from_thousandths"),
        _joined(G.translate(inner, box, F.lit(50.0), F.lit(25.0))).alias("translated"), near.alias("near"),
    )


def _capped_sql(w: str, h: str, most: int) -> tuple[str, str]:
    return tuple(f"CASE WHEN {w} * {h} <= {most} THEN {v} ELSE greatest(1, CAST(trunc({v} * sqrt({most}.0 / ({w} * {h}))) AS BIGINT)) END" for v in (w, h))


_FACTOR, _SHRUNK = 0.35, 0.7071067811865476
_W0, _H0 = (f"greatest(1, {_even(f'{v} * {_FACTOR}')})" for v in ("w", "h"))
_SIZES_SQL = f"""base AS (SELECT p_partkey, CAST(p_size * 60 AS BIGINT) AS w, CAST(floor(p_retailprice) AS BIGINT) AS h FROM part), sized AS (SELECT *, {_W0} AS rw, {_H0} AS rh FROM base),
  capped AS (SELECT *, {_capped_sql("rw", "rh", 200_000)[0]} AS cw, {_capped_sql("rw", "rh", 200_000)[1]} AS ch FROM sized),
  half AS (SELECT *, greatest(1, {_even(f"w * {_SHRUNK}")}) AS sw, greatest(1, {_even(f"h * {_SHRUNK}")}) AS sh FROM capped)"""


@REGISTRY.add(
    "image_sizes",
    sql=f"""WITH {_SIZES_SQL} SELECT p_partkey, rw AS resized_width, rh AS resized_height, cw AS shown_width, ch AS shown_height, CAST(ceil(cw / 32.0) * ceil(ch / 32.0) AS BIGINT) AS tokens,
      {_capped_sql("w", "h", 200_000)[0]} AS whole_width, {_capped_sql("sw", "sh", 200_000)[0]} AS shrunk_width, {_capped_sql("sw", "sh", 200_000)[1]} AS shrunk_height, round(greatest(w, h) / CAST(least(w, h) AS DOUBLE), 6) AS aspect,
      CASE WHEN greatest(w, h) / CAST(least(w, h) AS DOUBLE) <= 2 OR w >= h THEN w ELSE CAST(ceil(h / 2.0) AS BIGINT) END AS padded_width, CASE WHEN greatest(w, h) / CAST(least(w, h) AS DOUBLE) <= 2 OR w < h THEN h ELSE CAST(ceil(w / 2.0) AS BIGINT) END AS padded_height FROM half""",
)
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes scaled, capped, shrunk and padded, their tokens and aspect ratios."""
    w, h = (F.col("p_size") * 60).cast("int"), F.floor("p_retailprice").cast("int")
    size, most = F.array(w, h), F.lit(200_000)
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", G.resize(w, h, F.lit(_FACTOR)).alias("resized"), R.presented_size(size, F.lit(_FACTOR), most).alias("shown"), R.tokens_at(F.array(size), F.lit(_FACTOR), most).alias("tokens"),
        R.presented_size_unless_one(size, F.lit(1.0), most).alias("whole"), R.shrunk_size(size, most).alias("shrunk"), G.aspect_ratio(w, h).alias("aspect"), G.padded_size(w, h, 2.0).alias("padded"),
    )
    side = lambda c: [F.col(c)[0].alias(f"{c}_width"), F.col(c)[1].alias(f"{c}_height")]
    return plain(rows.select("p_partkey", *side("resized"), *side("shown"), "tokens", F.col("whole")[0].alias("whole_width"), *side("shrunk"), "aspect", *side("padded")))


@REGISTRY.add(
    "token_budgets",
    sql="""WITH b AS (SELECT p_partkey, CAST(p_size * 700 AS BIGINT) AS prompt, CASE WHEN p_partkey % 5 > 0 THEN 32768 END AS context FROM part)
      SELECT p_partkey, CASE WHEN context IS NOT NULL THEN greatest(0, context - prompt - 100) END AS available, coalesce(prompt + 2048 + 100 <= context, true) AS fits,
      p_partkey % 3 = 0 AS overflow FROM b""",
)
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens left for an answer, whether it fits, and errors that say it doesn't."""
    prompt, context = F.col("p_size") * 700, F.when(F.col("p_partkey") % 5 > 0, F.lit(32768))
    error = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("400: Maximum Context length is "), context.cast("string"), F.lit(" tokens"))).otherwise(F.lit("timeout"))
    said = F.coalesce(error, F.lit("Too many tokens"))
    return plain(table(spark, sf_dir, "part").select("p_partkey", B.available_tokens(prompt, context, 100).alias("available"), B.fits_context(prompt, context, F.lit(2048), 100).alias("fits"), B.context_overflow(said).alias("overflow")))


_SCORED = f"""{SAMPLES}, told AS (SELECT *, sample_index % 4 AS form FROM samples)"""


@REGISTRY.add(
    "sample_values",
    sql=f"""WITH {_SCORED} SELECT job_key, CASE form WHEN 2 THEN 1.0 WHEN 3 THEN NULL ELSE score END AS accuracy, coalesce(form <> 3 AND (form = 2 OR score IS NOT NULL), false) AS scored,
      coalesce(NOT coalesce(critical_failure, false) AND NOT (form <> 3 AND (form = 2 OR score IS NOT NULL)), false) AS to_judge,
      len(list_filter(coalesce(failure_reasons, []), lambda r: r IS NOT NULL)) > 0 OR coalesce(critical_failure, false) OR form = 1 AND score IS NOT NULL AND sample_index % 8 = 1 AS rerun,
      CAST(coalesce(prompt_tokens, 0) + coalesce(response_tokens_total, 0) AS DOUBLE) AS known_tokens, prompt_tokens + response_tokens_total AS sequence, CASE WHEN form = 0 AND score IS NOT NULL THEN 7.0 ELSE CAST(n_tool_calls AS DOUBLE) END AS tool_calls FROM told WHERE sample_index IS NOT NULL""",
)
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, tokens and state of samples whose scores come in different forms."""
    rows = samples(spark, sf_dir).where("sample_index is not null").withColumn("form", F.col("sample_index") % 4)
    text = F.col("score").cast("string")
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    scores = (
        F.when((F.col("form") == 0) & F.col("score").isNotNull(), pair("accuracy_reward", text, "n_tool_calls", "7"))
        .when((F.col("form") == 1) & F.col("score").isNotNull(), F.when(F.col("sample_index") % 8 == 1, pair("score", text, "error_type", "E")).otherwise(pair("accuracy_reward", "nan", "score", text)))
        .when(F.col("form") == 2, pair("reward", "1"))
    )
    rows = rows.withColumn("scores", scores)
    m, critical = F.col("scores"), F.col("critical_failure")
    own = {"n_tool_calls": F.col("n_tool_calls")}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rounded(rows.select(
        "job_key", S.accuracy(m).alias("accuracy"), S.has_score(m).alias("scored"), S.needs_judging(m, critical).alias("to_judge"), S.needs_rerun(F.col("failure_reasons"), critical, m).alias("rerun"),
        S.response_tokens(F.lit(None).cast("bigint"), zero("prompt_tokens"), zero("response_tokens_total")).alias("known_tokens"), S.sequence_length(F.col("prompt_tokens"), F.col("response_tokens_total")).cast("bigint").alias("sequence"),
        S.sample_number("n_tool_calls", m, own).alias("tool_calls"),
    ))


@REGISTRY.add(
    "unscored_failures",
    sql=f"""WITH {SAMPLES}, bad AS (SELECT coalesce(nullif(data_source, ''), 'unknown') AS data_source, unnest(CASE WHEN len(failure_reasons) > 0 THEN list_transform(failure_reasons, lambda r: coalesce(r, 'None')) ELSE ['critical_failure'] END) AS r
      FROM samples WHERE score IS NULL AND critical_failure) SELECT data_source, split_part(r, chr(10), 1) AS failure_reason, count(*) AS "count" FROM bad GROUP BY ALL""",
)
def unscored_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of the critical failures that have no score, per source."""
    return summary.unscored_failures(samples(spark, sf_dir))


@REGISTRY.add(
    "names_and_texts",
    sql=r"""SELECT row_id, replace(regexp_replace(regexp_replace(CAST(initial_rescale AS VARCHAR), '0+$', ''), '\.$', ''), '.', '') AS tag,
      CASE WHEN length(question) <= 20 THEN question ELSE substr(question, 1, 10) || '...(truncated)...' || right(question, 10) END AS middle, CASE WHEN length(question) <= 12 THEN question ELSE substr(question, 1, 12) || '... (' || (length(question) - 12) || ' more)' END AS short,
      CASE WHEN images[1] IS NOT NULL THEN 'file:///data/' || images[1] END AS first_url, TRY_CAST(regexp_extract(images[1], '(\d+)\.[A-Za-z0-9]+$', 1) AS INTEGER) AS first_page,
      CASE WHEN contains(data_source, '_unanswerable') THEN 'unanswerable' WHEN contains(data_source, '_answerable') THEN 'answerable' WHEN data_source IS NOT NULL THEN 'other' ELSE 'other' END AS answerability,
      CASE WHEN lower(trim(subset)) IN ('', 'none', 'null') THEN NULL ELSE trim(subset) END AS subset FROM manifest""",
)
def names_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, shortened texts, image addresses and pages of the manifest."""
    urls = datasets.image_urls(F.col("images"), "/data/")
    first = F.get(F.col("images"), F.lit(0))
    return plain(table(spark, sf_dir, "manifest").select(
        "row_id", T.rescale_tag(F.col("initial_rescale").cast("string")).alias("tag"), T.truncate(F.col("question"), 20).alias("middle"), T.short_text(F.col("question"), 12).alias("short"),
        F.get(urls, F.lit(0)).alias("first_url"), T.page_of_path(first).alias("first_page"), T.answerability(F.col("data_source")).alias("answerability"), V.optional_text(F.col("subset")).alias("subset"),
    ))


@REGISTRY.add(
    "paths_and_boxes",
    sql=r"""SELECT sample_id, document_id, CASE WHEN starts_with(page_image_path, document_id || '/') THEN 'http://h/' || page_image_path ELSE page_image_path END AS path,
      trim(regexp_replace(document_id, '[^\p{L}\p{N}._-]+', '_', 'g'), '_') AS safe, CASE WHEN len(bbox) = 4 THEN 1 ELSE 0 END AS boxes, CAST(page_id AS BIGINT) AS page FROM region_desc_samples""",
)
def paths_and_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten paths, safe names, boxes written in a text and read back, and pages."""
    written = F.concat(F.lit("see <box>("), F.array_join(F.col("bbox").cast("array<string>"), ", "), F.lit(")</box> and <box>(1, 2)</box>"))
    own = F.when(F.col("page_image_path").startswith(F.concat("document_id", F.lit("/"))), T.rewrite_prefix(F.concat(F.lit("/root/"), F.col("page_image_path")), {"/root": "http://h", "/ro": "x"})).otherwise(F.col("page_image_path"))
    pages = T.page_numbers(F.concat(F.lit("["), F.col("page_id").cast("string"), F.lit("]")))
    return table(spark, sf_dir, "region_desc_samples").select("sample_id", "document_id", own.alias("path"), T.safe_name(F.col("document_id")).alias("safe"), F.coalesce(F.size(T.boxes_in_text(written)), F.lit(0)).alias("boxes"), F.get(pages, F.lit(0)).cast("bigint").alias("page"))


@REGISTRY.add("config_identity", sql="""SELECT event_id, '{"a":' || CAST(event_id AS VARCHAR) || ',"k":' || json_extract_string(props, '$.k') || '}' AS canonical, sha256('{"k":' || json_extract_string(props, '$.k') || ',"ray_vllm":{}}') AS digest FROM events""")
def config_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON, and a hash that transport settings don't change."""
    k = F.get_json_object("props", "$.k")
    messy = F.concat(F.lit('{ "k" : '), k, F.lit(', "a": '), F.col("event_id").cast("string"), F.lit("}"))
    config = F.concat(F.lit('{"ray_vllm": {"gpu_memory_utilization": 0.'), F.col("event_id").cast("string"), F.lit('}, "k": '), k, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", identity.canonical_json(messy).alias("canonical"), identity.config_hash(config).alias("digest"))


@REGISTRY.add(
    "benchmark_rows",
    sql=r"""SELECT row_id, 'v' AS data_source, question || chr(10) || 'A. ' || answer || chr(10) || 'B. none' AS question, answer, 'file:///d/' || images[1] AS image, CAST(row_id AS VARCHAR) AS question_id, subset FROM manifest""",
)
def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest read as a multiple choice benchmark."""
    rows = table(spark, sf_dir, "manifest").select(F.col("row_id").alias("question_id"), "question", F.concat(F.lit("A. "), F.col("answer"), F.lit("\\nB. none")).alias("options"), "answer", F.get("images", F.lit(0)).alias("image"), "subset")
    out = datasets.benchmark_rows(rows, "multiple_choice", "v", "/d/")
    return out.select(F.col("extra_info.question_id").cast("bigint").alias("row_id"), "data_source", "question", "answer", "image", "extra_info.question_id", "extra_info.subset")


@REGISTRY.add(
    "chat_messages",
    sql="""SELECT row_id, coalesce(len(images), 0) AS n_images, coalesce(len(images), 0) + CASE WHEN length(replace(coalesce(question, ''), '<image>', '')) > 0 THEN 1 ELSE 0 END AS n_parts, 'user' AS role,
      CASE WHEN len(images) > 1 THEN images[2] ELSE images[1] END AS first_url FROM manifest""",
)
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's questions as chat messages with one image tag each; images left over come first."""
    content = F.concat(F.lit("<image>"), F.replace(F.coalesce("question", F.lit("")), F.lit("<image>"), F.lit("")))
    prompt = F.array(F.struct(F.lit(None).cast("string").alias("role"), content.alias("content")))
    rows = table(spark, sf_dir, "manifest").select("row_id", F.get(records.chat_messages(prompt, F.col("images")), F.lit(0)).alias("m"))
    shown = F.filter("m.parts", lambda p: p["type"] == "image_url")
    return plain(rows.select("row_id", F.size(shown).alias("n_images"), F.size("m.parts").alias("n_parts"), "m.role", F.get(shown, F.lit(0))["url"].alias("first_url")))


@REGISTRY.add(
    "packed_references",
    sql="""WITH i AS (SELECT DISTINCT page_image_path AS path FROM region_desc_samples WHERE page_image_path IS NOT NULL), r AS (SELECT row_id, unnest(images) AS path FROM manifest)
      SELECT CASE WHEN i.path IS NULL THEN 'missing' ELSE 'packed' END AS state, count(*) AS n, count(DISTINCT CASE WHEN i.path IS NOT NULL THEN r.path END) AS n_targets FROM r LEFT JOIN i USING (path) WHERE r.path IS NOT NULL GROUP BY 1""",
)
def packed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's images found among the page images and packed under their content's name, and those that are missing."""
    images = table(spark, sf_dir, "region_desc_samples").where("page_image_path is not null").select("page_image_path").distinct().select(F.concat(F.lit("file:/d/"), "page_image_path").alias("path"), F.col("page_image_path").cast("binary").alias("content"))
    none = F.lit(None).cast("string")
    refs = F.transform("images", lambda i: F.struct(F.lit("path").alias("source_type"), F.concat(F.lit("/d/"), i).alias("path"), none.alias("value"), none.alias("url"), none.alias("uri")))
    packed, _ = records.pack_references(table(spark, sf_dir, "manifest").select(F.col("row_id").alias("json_name"), refs.alias("input_images")), images)
    known = packed.where("value is not null")
    return known.groupBy(F.when(F.col("packed").isNull(), "missing").otherwise("packed").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("packed").alias("n_targets"))


#: What a crop's parent is shown as, and the call of every kind with its verdict.
_VERDICTS = (None, "other_tool", "inexact_arguments", "box_differs", None, "not_an_object", "other_parent", "not_one_image")


@REGISTRY.add(
    "exact_calls",
    sql=f"""SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS call_no, [{", ".join("NULL" if v is None else repr(v) for v in _VERDICTS)}][CAST(l_partkey % 8 + 1 AS INTEGER)] AS reason,
      CASE WHEN l_partkey % 8 IN (0, 4) THEN '{{"img_idx": 0, "label": "part ' || l_partkey || '", "bbox_2d": [' || {_even("l_quantity * 1000 / 200")} || ', 100, 900, 800]}}' END AS arguments FROM lineitem""",
)
def exact_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every kind held against the crops they made."""
    rows = table(spark, sf_dir, "lineitem")
    form, label, left = F.col("l_partkey") % 8, F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.bround(F.col("l_quantity") * 1000 / 200).cast("int")
    call = lambda idx, name, box: F.concat(F.lit(f'{{"name": "{name}", "arguments": {{"label": "'), label, F.lit(f'", "img_idx": {idx}, "bbox_2d": '), box, F.lit("}}"))
    near = F.concat(F.lit("["), left.cast("string"), F.lit(", 100, 901, 799]"))
    text = (
        F.when(form == 0, F.concat(F.lit('{"img_idx": 0, "region_description": "'), label, F.lit('"}'))).when(form == 1, call(0, "other", near)).when(form == 2, call(0, conversations.ZOOM, F.lit("[1, 2]")))
        .when(form == 3, call(0, conversations.ZOOM, F.concat(F.lit("["), (left + 2).cast("string"), F.lit(", 100, 900, 800]")))).when(form == 4, call(0, conversations.ZOOM, near))
        .when(form == 5, F.lit("[1]")).when(form == 6, call(2, conversations.ZOOM, near)).otherwise(call(0, conversations.ZOOM, near))
    )
    box = F.array(F.floor("l_quantity").cast("double"), F.lit(10.0), F.lit(180.0), F.lit(80.0))
    none = F.lit(None)
    shown = F.array(
        F.struct(F.lit(0).alias("presented_img_idx"), F.lit("initial").alias("kind"), none.cast("int").alias("parent_presented_img_idx"), none.cast("array<double>").alias("bbox_on_presented"), F.array(F.lit(200.0), F.lit(100.0)).alias("display_size")),
        F.struct(F.lit(1).alias("presented_img_idx"), F.lit("region_crop").alias("kind"), F.lit(0).alias("parent_presented_img_idx"), box.alias("bbox_on_presented"), F.array(F.lit(9.0), F.lit(9.0)).alias("display_size")),
    ).cast(conversations.SHOWN)
    presented = F.when(form == 7, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    numbered = readers.position(rows.select(*order), order)
    return numbered.select((F.col("index") + 1).alias("call_no"), conversations.exact_call(text, presented, shown).alias("c")).select("call_no", "c.reason", "c.arguments")


@REGISTRY.add("identity_changes", sql="""WITH a AS (SELECT data_source AS item, count(*) AS n FROM manifest GROUP BY 1), b AS (SELECT data_source AS item, count(*) AS n FROM manifest WHERE split = 'train' GROUP BY 1)
  SELECT a.item, a.n AS before, b.n AS now, CASE WHEN b.n IS NULL THEN 'removed' ELSE 'shrunk' END AS change FROM a LEFT JOIN b ON a.item IS NOT DISTINCT FROM b.item WHERE b.n IS NULL OR b.n < a.n""")
def identity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that keep a run over the whole manifest from going on over its train split."""
    rows = table(spark, sf_dir, "manifest")
    sizes = lambda df: df.groupBy(F.col("data_source").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return logs.identity_changes(sizes(rows), sizes(rows.where("split = 'train'")))


@REGISTRY.add(
    "io_round_trips",
    sql="""SELECT * FROM (VALUES ('jsonl', (SELECT count(*) FROM region_desc_samples)), ('tsv', (SELECT count(*) FROM supplier)), ('csv', (SELECT count(*) FROM supplier)), ('partitioned', (SELECT count(*) FROM customer)), ('splits', (SELECT count(*) FROM customer WHERE c_nationkey < 5)),
      ('ids', (SELECT count(DISTINCT question_id) FROM manifest WHERE trim(question_id) <> '')), ('parquet_with_origin', 2 * (SELECT count(*) FROM nation)), ('bundle', (SELECT count(*) FROM nation)), ('settings', (SELECT count(*) FROM region)),
      ('checkpoints', (SELECT count(*) FROM checkpoint_rows WHERE sample IS NOT NULL AND job_idx IS NOT NULL)), ('conversations', (SELECT count(*) FROM region))) t(kind, n_rows)""",
)
def io_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come back equal from what each sink wrote and each reader read."""
    root = scratch(spark)
    t = lambda name: table(spark, sf_dir, name)
    same = lambda a, b: a.select(*sorted(b.columns)).exceptAll(b.select(*sorted(b.columns))).count()
    found: list[tuple[str, int]] = []

    def note(kind: str, back: DataFrame, sent: DataFrame) -> None:
        found.append((kind, back.count() - same(back, sent)))

    regions = t("region_desc_samples")
    sinks.write_jsonl(regions, f"{root}/jsonl")
    note("jsonl", readers.read_jsonl(spark, f"{root}/jsonl", readers.REGIONS), regions)
    supplier = t("supplier")
    ddl = ", ".join(f"{n} {k}" for n, k in sorted(supplier.dtypes))
    sinks.write_delimited(supplier, f"{root}/tsv", "\t")
    note("tsv", readers.read_tsv(spark, f"{root}/tsv", ddl).drop("path"), supplier)
    sinks.write_delimited(supplier, f"{root}/csv")
    note("csv", spark.read.schema(ddl).option("header", True).csv(f"{root}/csv"), supplier)
    customer = t("customer")
    sinks.write_partitioned(customer, f"{root}/partitioned", "c_nationkey")
    note("partitioned", spark.read.schema(customer.schema).json(f"{root}/partitioned"), customer)
    part = customer.withColumn("part", F.when(F.col("c_nationkey") < 5, "val").otherwise("train"))
    sinks.write_splits(part, f"{root}/splits")
    note("splits", spark.read.parquet(f"{root}/splits").where("part = 'val'"), part.where("part = 'val'"))
    ids = t("manifest").select(V.clean_text(F.col("question_id")).alias("id")).where("id <> ''").distinct()
    sinks.write_ids(t("manifest"), "question_id", f"{root}/ids")
    note("ids", readers.read_id_list(spark, f"{root}/ids"), ids)
    nation = t("nation")
    for name in ("b", "a"):
        nation.coalesce(1).write.parquet(f"{root}/{name}")
    both = readers.read_parquet_with_origin(spark, [f"{root}/b", f"{root}/a"])
    note("parquet_with_origin", both.where("file_no in (0, 1) and row_index is not null").select(*nation.columns), nation.unionAll(nation))
    sinks.write_bundle({"nation": nation}, f"{root}/bundle")
    note("bundle", spark.read.schema(nation.schema).option("multiLine", True).json(f"{root}/bundle/nation.json"), nation)
    settings = t("region").select(F.concat(F.lit("K"), F.col("r_regionkey").cast("string"), F.lit("='"), F.col("r_name"), F.lit("'")).alias("value"))
    settings.unionAll(spark.createDataFrame([("# note",), ("nothing",)], "value string")).coalesce(1).write.text(f"{root}/settings")
    wanted = t("region").select(F.concat(F.lit("K"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("value"))
    note("settings", readers.read_settings(spark, f"{root}/settings").select("key", "value"), wanted)
    lines = t("checkpoint_rows").drop("line_id").where("sample is not null and job_idx is not null")
    lines.select("job_idx", "job_key", "written_at", "sample").write.json(f"{root}/checkpoints")
    note("checkpoints", readers.read_checkpoints(spark, f"{root}/checkpoints").select("job_idx", "job_key"), lines.select("job_idx", "job_key"))
    exported = t("region").withColumn("rescale", F.concat(F.lit("0"), F.col("r_regionkey").cast("string")))
    for r in exported.collect():  # the five rows of a fixed table
        spark.createDataFrame([(r.r_regionkey, r.r_name)], "r_regionkey int, r_name string").coalesce(1).write.json(f"{root}/conversations/rescale{r.rescale}/{r.r_regionkey}")
    note("conversations", readers.read_conversations(spark, f"{root}/conversations", "r_regionkey int, r_name string").select("r_regionkey", "r_name", F.regexp_replace("rescale", "^rescale", "").alias("rescale")), exported)
    return spark.createDataFrame(found, "kind string, n_rows bigint")


