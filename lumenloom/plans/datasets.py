"""Queries of the dataset, sampling, text and conversation operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import geometry as G
from lumenloom.functions import text as T
from lumenloom.operators import conversations, datasets, logs, sampling
from lumenloom.plans.evaluation import SAMPLES, rounded, samples
from lumenloom.plans.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.add("retained_semi", sql="SELECT row_id, question_id FROM manifest WHERE question_id IN (SELECT question_id FROM region_desc_samples WHERE question_id IS NOT NULL)")
def retained_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows whose question is in a list."""
    ids = table(spark, sf_dir, "region_desc_samples").select("question_id")
    return table(spark, sf_dir, "manifest").select("row_id", "question_id").join(ids, "question_id", "left_semi").select("row_id", "question_id")


@REGISTRY.add("retained_anti", sql="SELECT row_id, question_id FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM region_desc_samples r WHERE r.question_id = m.question_id)")
def retained_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows whose question isn't in a list; null ids stay."""
    ids = table(spark, sf_dir, "region_desc_samples").select("question_id")
    return table(spark, sf_dir, "manifest").select("row_id", "question_id").join(ids, "question_id", "left_anti").select("row_id", "question_id")


@REGISTRY.add("limit_per_group", sql="SELECT data_source, row_id FROM manifest QUALIFY row_number() OVER (PARTITION BY data_source ORDER BY received_at NULLS FIRST, row_id) <= 3")
def limit_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rows of each source that came first."""
    rows = table(spark, sf_dir, "manifest").select("data_source", "row_id", "received_at")
    return sampling.limit_per_group(rows, "data_source", [F.asc_nulls_first("received_at"), "row_id"], 3).select("data_source", "row_id")


@REGISTRY.add("first_occurrence", sql="SELECT row_id, row_number() OVER (PARTITION BY split_part(document_id, '_', 1) ORDER BY row_id) = 1 AS is_first FROM manifest")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row is the first of its kind of document."""
    rows = table(spark, sf_dir, "manifest").select("row_id", "document_id")
    return sampling.first_occurrence(rows, F.split_part(F.col("document_id"), F.lit("_"), F.lit(1)), ["row_id"]).select("row_id", "is_first")


@REGISTRY.add("hash_sample", sql="SELECT doc_id FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of a hundred documents."""
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@REGISTRY.add("hash_split", sql="SELECT doc_id, CASE WHEN substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8) < '051eb851' THEN 'val' ELSE 'train' END AS part FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two per cent of the documents for validation."""
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.02)


@REGISTRY.add(
    "head_split",
    sql="SELECT row_id, CASE WHEN row_number() OVER (ORDER BY row_id) <= (SELECT least(greatest(1, CAST(floor(count(*) * 0.02) AS BIGINT)), count(*) - 1) FROM manifest) THEN 'val' ELSE 'train' END AS part FROM manifest",
)
def head_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two per cent of the manifest for validation."""
    return sampling.head_split(table(spark, sf_dir, "manifest").select("row_id"), ["row_id"], 0.02)


@REGISTRY.add("question_types", sql="""SELECT row_id, CASE WHEN starts_with(question_type, '[') THEN array_to_string(CAST(json(question_type) AS VARCHAR[]), '|') WHEN trim(question_type) <> '' THEN trim(question_type) ELSE '' END AS types FROM manifest""")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question types given as a word or as JSON text, as one list."""
    return table(spark, sf_dir, "manifest").select("row_id", F.array_join(datasets.question_types(F.col("question_type")), "|").alias("types"))


_DETAILS = "[{\"kind\":\"VARCHAR\",\"page\":\"INTEGER\",\"caption\":\"VARCHAR\",\"regions\":[{\"bbox\":[\"DOUBLE\"],\"label\":\"VARCHAR\"}]}]"
_EVIDENCE = f"""each AS (SELECT row_id, unnest(from_json(question_involved_visual_details, '{_DETAILS}')) AS d FROM manifest WHERE question_involved_visual_details IS NOT NULL),
  boxes AS (SELECT row_id, d.kind AS kind, d.page AS page, unnest(d.regions) AS r FROM each)"""


@REGISTRY.add(
    "visual_evidence",
    sql=f"WITH {_EVIDENCE} SELECT row_id, kind, page, r.label AS label, r.bbox[1] AS x1, r.bbox[2] AS y1, r.bbox[3] AS x2, r.bbox[4] AS y2 FROM boxes WHERE len(r.bbox) = 4 AND r.bbox[3] > r.bbox[1] AND r.bbox[4] > r.bbox[2]",
)
def visual_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence boxes from the manifest's JSON text."""
    box = F.col("box")
    rows = datasets.evidence_boxes(table(spark, sf_dir, "manifest"), ("row_id",))
    return rows.select("row_id", "kind", "page", "label", *[box[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


_PAGES = f"""WITH imgs AS (SELECT row_id, list_sort(list_distinct(list_filter(list_transform(images, lambda i: TRY_CAST(regexp_extract(i, '(?:^|/)(\\d+)\\.[A-Za-z0-9]+$', 1) AS INTEGER)), lambda p: p IS NOT NULL))) AS b FROM manifest WHERE images IS NOT NULL),
  det AS (SELECT row_id, list_sort(list_distinct(list_filter(list_transform(from_json(question_involved_visual_details, '{_DETAILS}'), lambda d: d.page), lambda p: p IS NOT NULL))) AS a FROM manifest WHERE question_involved_visual_details IS NOT NULL)"""


@REGISTRY.add(
    "page_set_ops",
    sql=_PAGES + """ SELECT imgs.row_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), b))), ',') AS both_pages, array_to_string(list_sort(list_intersect(coalesce(a, []), b)), ',') AS common,
      array_to_string(list_sort(list_filter(coalesce(a, []), lambda p: NOT list_contains(b, p))), ',') AS only_a, len(list_filter(coalesce(a, []), lambda p: NOT list_contains(b, p))) = 0 AS covered FROM imgs LEFT JOIN det USING (row_id)""",
)
def page_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of evidence and of images as sets."""
    rows = table(spark, sf_dir, "manifest").where("images is not null")
    a, b = datasets.question_pages(F.col("question_involved_visual_details")), F.array_distinct(datasets.pages_of_images(F.col("images")))
    sets = datasets.page_sets(F.col("a"), F.col("b"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    paired = rows.select("row_id", a.alias("a"), b.alias("b"))
    return paired.select("row_id", text(sets["both"]).alias("both_pages"), text(sets["common"]).alias("common"), text(sets["only_a"]).alias("only_a"), sets["covered"].alias("covered"))


@REGISTRY.add(
    "rl_rows",
    sql="""SELECT data_source, 'zoom_agent' AS agent_name, repeat('<image>', len(images)) || replace(question, '<image>', '') AS content, len(images) AS n_images, answer AS ground_truth, row_id AS "index", question_id
      FROM manifest WHERE len(images) > 0 AND trim(replace(question, '<image>', '')) <> ''""",
)
def rl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows from the manifest, flattened for comparison."""
    rows = datasets.rl_rows(table(spark, sf_dir, "manifest"), "zoom_agent")
    return rows.select("data_source", "agent_name", F.col("prompt")[0]["content"].alias("content"), F.size("images").cast("bigint").alias("n_images"), F.col("reward_model.ground_truth").alias("ground_truth"), "extra_info.index", "extra_info.question_id")


@REGISTRY.add(
    "region_rows",
    sql="""SELECT sample_id, coalesce(question_id, sample_id) AS question_id, coalesce(page_image_path, 'images/' || document_id || '/' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '.jpg') AS image,
      replace(region_description, '<image>', '< image >') AS target, CASE WHEN len(bbox) = 4 AND bbox[3] > bbox[1] AND bbox[4] > bbox[2] THEN (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) END AS area FROM region_desc_samples""",
)
def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region localisation rows with the area of their box."""
    return datasets.region_rows(table(spark, sf_dir, "region_desc_samples")).withColumn("area", G.area(F.col("box"))).drop("box")


@REGISTRY.add("group_with_nulls", sql="SELECT subset, data_source, count(*) AS n, round(avg(initial_rescale), 6) AS mean_rescale FROM manifest GROUP BY ALL")
def group_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by two columns, null groups kept."""
    return rounded(table(spark, sf_dir, "manifest").groupBy("subset", "data_source").agg(F.count(F.lit(1)).alias("n"), F.avg("initial_rescale").alias("mean_rescale")))


@REGISTRY.add("value_counts", sql="SELECT initial_rescale, count(*) AS n FROM manifest GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rescale occurs, null included, in order."""
    return table(spark, sf_dir, "manifest").groupBy("initial_rescale").agg(F.count(F.lit(1)).alias("n")).orderBy("initial_rescale")


@REGISTRY.add(
    "source_reconciliation",
    sql="""WITH e AS (SELECT data_source, count(*) AS expected FROM manifest WHERE split = 'train' GROUP BY 1), a AS (SELECT data_source, count(*) AS actual FROM manifest WHERE answer IS NOT NULL AND question IS NOT NULL AND split IN ('train', 'val') GROUP BY 1)
      SELECT CASE WHEN expected IS NOT NULL THEN e.data_source ELSE a.data_source END AS data_source, expected, coalesce(actual, 0) AS actual, expected = coalesce(actual, 0) AS matches FROM e FULL JOIN a ON a.data_source IS NOT DISTINCT FROM e.data_source""",
)
def source_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected rows of each source (its training rows) beside those retained of training and validation."""
    rows = table(spark, sf_dir, "manifest")
    expected = rows.where("split = 'train'").groupBy("data_source").agg(F.count(F.lit(1)).alias("expected"))
    return datasets.reconciled(expected, rows.where("answer is not null and question is not null and split in ('train', 'val')"), "data_source")


@REGISTRY.add(
    "reason_texts",
    sql="""WITH r AS (SELECT line_id, sample.failure_reasons AS fr, len(sample.failure_reasons) AS n FROM checkpoint_rows WHERE sample IS NOT NULL)
      SELECT line_id, CASE WHEN n > 1 THEN fr[1] || '; ... (' || n || ' reasons total)' WHEN n > 0 THEN fr[1] END AS first_reason, regexp_replace(regexp_replace(translate(fr[1], '/ .:-', '_____'), '[^A-Za-z0-9_]+', '_', 'g'), '^_|_$', '', 'g') AS name FROM r""",
)
def reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failure reason of every sample, with their number if there are more, and as part of a name."""
    reasons = F.col("sample.failure_reasons")
    return table(spark, sf_dir, "checkpoint_rows").where("sample is not null").select("line_id", T.first_reasons(reasons, 1).alias("first_reason"), T.slug(F.get(reasons, F.lit(0))).alias("name"))


def _needles(text: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


@REGISTRY.add(
    "unanswerable",
    sql=f"""SELECT row_id, {_needles("lower(concat_ws(' ', question_type, answer, question_id))", T.UNANSWERABLE_RECORD)} AS by_record,
      {_needles("lower(concat_ws(' ', question_type, answer, subset))", T.UNANSWERABLE_OUTPUT)} AS by_output FROM manifest""",
)
def unanswerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that say that there is no answer, by either detector."""
    by_record = T.unanswerable_text(F.col("question_type"), F.col("answer"), F.col("question_id"), needles=T.UNANSWERABLE_RECORD)
    by_output = T.unanswerable_text(F.col("question_type"), F.col("answer"), F.col("subset"))
    return table(spark, sf_dir, "manifest").select("row_id", by_record.alias("by_record"), by_output.alias("by_output"))


# What counts as white space between words.
_SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')"


@REGISTRY.add(
    "text_statistics",
    sql=f"SELECT doc_id, length(text) AS n_chars, len({_WORDS}) AS n_words, len(list_distinct({_WORDS})) AS n_unique, CAST(ceil(len({_WORDS}) / 0.75) AS BIGINT) AS token_estimate FROM documents",
)
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, words, distinct words and estimated tokens of every document; a null text has null characters and no words."""
    words = T.split_words(F.col("text"))
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.size(words).cast("bigint").alias("n_words"), F.size(F.array_distinct(words)).cast("bigint").alias("n_unique"), T.token_estimate(F.col("text")).alias("token_estimate"))


_TOKENS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


@REGISTRY.add(
    "degenerate_documents",
    sql=f"""WITH d AS (SELECT doc_id, length(text) AS n_chars, {_TOKENS} AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
      runs AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS g FROM w) GROUP BY doc_id, w, g) GROUP BY 1),
      grams AS (SELECT doc_id, count(*) - count(DISTINCT g) AS repeats FROM (SELECT d.doc_id, array_to_string(ws[i + 1:i + 8], ' ') AS g FROM d JOIN w USING (doc_id) WHERE len(ws) >= 1000 AND i <= len(ws) - 8) GROUP BY 1),
      r AS (SELECT d.doc_id, list_filter([CASE WHEN n_chars > 50000 THEN 'too_many_chars' END, CASE WHEN len(ws) > 8000 THEN 'too_many_words' END, CASE WHEN len(ws) >= 1000 AND len(list_distinct(ws)) / len(ws) < 0.2 THEN 'low_unique_ratio' END,
        CASE WHEN run > 10 THEN 'repeated_word' END, CASE WHEN repeats > 50 THEN 'repeated_ngram' END], lambda x: x IS NOT NULL) AS reasons FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN grams USING (doc_id))
      SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0""",
)
def degenerate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with signs of degenerate text and which these are."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.degenerate_reasons(F.col("text")), ",").alias("reasons")).where("reasons <> ''")


@REGISTRY.add("exact_duplicates", sql="SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@REGISTRY.add(
    "rescale_under_budget",
    sql="""WITH RECURSIVE s AS (SELECT p_partkey, p_size * 60 AS w, CAST(floor(p_retailprice) AS BIGINT) AS h, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM part
      UNION ALL SELECT p_partkey, w, h, CASE WHEN ceil(w * (lo + hi) / 2 / 32.0) * ceil(h * (lo + hi) / 2 / 32.0) <= 600 THEN (lo + hi) / 2 ELSE lo END,
        CASE WHEN ceil(w * (lo + hi) / 2 / 32.0) * ceil(h * (lo + hi) / 2 / 32.0) <= 600 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM s WHERE i < 24)
      SELECT p_partkey, round(CASE WHEN ceil(w / 32.0) * ceil(h / 32.0) <= 600 THEN 1.0 ELSE lo END, 6) AS factor FROM s WHERE i = 24""",
)
def rescale_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rescale whose image tokens stay within a budget."""
    w, h = F.col("p_size") * 60, F.floor("p_retailprice")
    fits = lambda f: F.ceil(w * f / 32.0) * F.ceil(h * f / 32.0) <= 600
    return rounded(table(spark, sf_dir, "part").select("p_partkey", G.largest_factor(fits).alias("factor")))


_TYPES = ("tool_call", "answer", "answer_revision", "others", "tool_result", "answer_verification_hint", "format_repair_hint", "query")
_MESSAGES_SQL = f"""messages AS (SELECT l_orderkey AS conv, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS step,
  [{", ".join(repr(t) for t in _TYPES)}][CAST(l_partkey % 8 + 1 AS INTEGER)] AS type FROM lineitem)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("l_partkey") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conv"), F.row_number().over(order).cast("bigint").alias("step"), kind.alias("type"), F.col("l_suppkey").cast("string").alias("text"))
    return rows.withColumn("role", F.when(F.col("type").isin("tool_call", "answer", "answer_revision", "others"), "assistant").otherwise("user"))


@REGISTRY.add("message_type_counts", sql=f"WITH {_MESSAGES_SQL} SELECT type, count(*) AS n FROM messages GROUP BY 1")
def message_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per type."""
    return conversations.type_counts(_messages(spark, sf_dir))


@REGISTRY.add("next_message_patterns", sql=f"WITH {_MESSAGES_SQL}, p AS (SELECT type, lead(type, 1) OVER w AS next1, lead(type, 2) OVER w AS next2 FROM messages WINDOW w AS (PARTITION BY conv ORDER BY step)) SELECT type, next1, next2, count(*) AS n FROM p GROUP BY ALL")
def next_message_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which types follow which."""
    return conversations.next_patterns(_messages(spark, sf_dir), "conv", "step")


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.training_rows(conversations.collect(_messages(spark, sf_dir), "conv", "step"))


@REGISTRY.add("convert_conversations")
def convert_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as training rows, or why they are dropped."""
    return _training(spark, sf_dir).select("conv", "drop_reason", "kept")


@REGISTRY.add("drop_reasons")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped conversations per reason."""
    return conversations.drop_reasons(_training(spark, sf_dir))


@REGISTRY.add(
    "running_image_index",
    sql=f"WITH {_MESSAGES_SQL} SELECT conv, step, CAST(coalesce(sum(CASE WHEN type = 'tool_result' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS image_index FROM messages",
)
def running_image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images came before each message."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return _messages(spark, sf_dir).select("conv", "step", F.coalesce(F.sum(F.when(F.col("type") == "tool_result", 1).otherwise(0)).over(before), F.lit(0)).alias("image_index"))


@REGISTRY.add("judge_queue", sql=f"WITH {SAMPLES} SELECT job_key, CASE WHEN critical_failure THEN 'critical' WHEN score IS NOT NULL THEN 'scored' ELSE 'pending' END AS state FROM samples")
def judge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which samples are scored, pending or never judged."""
    return samples(spark, sf_dir).select("job_key", F.when(F.col("critical_failure"), "critical").when(F.col("score").isNotNull(), "scored").otherwise("pending").alias("state"))


@REGISTRY.add(
    "sample_question_join",
    sql=f"""WITH {SAMPLES}, q AS (SELECT question_id, arg_max(subset, row_id) AS subset, max(row_id) AS row_id FROM manifest WHERE question_id IS NOT NULL GROUP BY 1)
      SELECT s.job_key, q.row_id, q.subset FROM samples s LEFT JOIN q ON q.question_id = s.question_id""",
)
def sample_question_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the latest manifest row of their question."""
    rows = table(spark, sf_dir, "manifest").select("question_id", "row_id", "subset")
    last = rows.where("question_id is not null").groupBy("question_id").agg(F.max_by("subset", "row_id").alias("subset"), F.max("row_id").alias("row_id"))
    return samples(spark, sf_dir).select("job_key", "question_id").join(last, "question_id", "left").select("job_key", "row_id", "subset")


@REGISTRY.add("latest_manifest_rows", sql="SELECT question_id, document_id, row_id FROM manifest WHERE question_id IS NOT NULL AND document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id, document_id ORDER BY received_at DESC NULLS LAST, row_id DESC) = 1")
def latest_manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each question of a document."""
    rows = table(spark, sf_dir, "manifest").select("question_id", "document_id", "received_at", "row_id")
    return logs.latest_wins(rows, ["question_id", "document_id"], ["received_at", "row_id"]).select("question_id", "document_id", "row_id")
