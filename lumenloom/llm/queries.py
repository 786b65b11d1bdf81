"""Queries of the training-data operators for language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import bpe, harm, mixing, overlap, packing
from lumenloom.plans.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation row that ask the same of the same document."""
    return overlap.cross_split_pairs(table(spark, sf_dir, "manifest"))


@REGISTRY.add("p2_report")
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rows and pairs per split and source."""
    return overlap.overlap_report(table(spark, sf_dir, "manifest"))


@REGISTRY.add("p2_coverage")
def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each evaluation row found in training."""
    return overlap.evaluation_coverage(table(spark, sf_dir, "manifest"))


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest").where("split = 'train'").select("row_id", "data_source")


_SOURCE_KEY = "replace(lower(regexp_replace({}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), '-', '_')"

_MIX_SQL = f"""
WITH counts AS (
  SELECT {_SOURCE_KEY.format("data_source")} AS key, count(*) AS n FROM manifest WHERE split = 'train' AND data_source IS NOT NULL GROUP BY 1
), plan AS (
  SELECT w.source, c.key, w.weight, w.max_repeats, coalesce(c.n, 0) AS n_rows, sum(coalesce(c.n, 0)) OVER () AS total, {_SOURCE_KEY.format("w.source")} AS name
  FROM mix_weights w LEFT JOIN counts c ON c.key = {_SOURCE_KEY.format("w.source")}
), quotas AS (
  SELECT *, weight * total AS quota, max_repeats * n_rows AS cap FROM plan
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY quota - floor(quota) DESC, name) AS place, round(sum(quota) OVER ()) - sum(floor(quota)) OVER () AS missing FROM quotas
), targets AS (
  SELECT *, CAST(floor(quota) + CASE WHEN place <= missing THEN 1 ELSE 0 END AS BIGINT) AS target FROM ranked
), mixed AS (SELECT *, least(target, cap) AS actual FROM targets)
"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_train(spark, sf_dir), table(spark, sf_dir, "mix_weights"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_train(spark, sf_dir), table(spark, sf_dir, "mix_weights"))


@REGISTRY.add("p3_found", sql=_MIX_SQL + "SELECT source FROM quotas WHERE quota > cap")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their share, by what the mix gave them."""
    return mixing.short_sources(_plan(spark, sf_dir), _mixed(spark, sf_dir))


@REGISTRY.add(
    "p3_report",
    sql=_MIX_SQL
    + """SELECT source, n_rows, max_repeats, weight AS target_share, target, CAST(actual AS BIGINT) AS actual, round(actual / sum(actual) OVER (), 9) AS actual_share, round(actual / total, 9) AS share_of_target,
      CAST(CASE WHEN actual > 0 THEN ceil(actual / n_rows) ELSE 0 END AS INTEGER) AS most_used, quota <= cap AS feasible FROM mixed""",
)
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, counted in the mix."""
    report = mixing.mix_report(_plan(spark, sf_dir), _mixed(spark, sf_dir))
    return report.withColumns({c: F.round(c, 9) for c in ("actual_share", "share_of_target")})


@REGISTRY.add("p3_mix")
def p3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed training records, shard by shard."""
    return _mixed(spark, sf_dir)


@REGISTRY.add(
    "p3_uses",
    sql=_MIX_SQL
    + """SELECT source, CAST(actual AS BIGINT) AS n_slots, CAST(least(actual, n_rows) AS BIGINT) AS n_records, CAST(actual // n_rows + CASE WHEN actual % n_rows > 0 THEN 1 ELSE 0 END AS BIGINT) AS most_used,
      CAST(greatest(1, actual // n_rows) AS BIGINT) AS least_used FROM mixed WHERE actual > 0""",
)
def p3_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the mix: slots, distinct records in them, and how often the most and the least used record is used."""
    uses = _mixed(spark, sf_dir).groupBy("source", "row_id").agg(F.count(F.lit(1)).alias("n"))
    return uses.groupBy("source").agg(F.sum("n").alias("n_slots"), F.count(F.lit(1)).alias("n_records"), F.max("n").alias("most_used"), F.min("n").alias("least_used"))


@REGISTRY.add("p5_ids")
def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


@REGISTRY.add("p5_round_trip", sql="SELECT source, count(*) AS n_documents, count(*) AS n_same FROM documents GROUP BY source")
def p5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source whose decoded ids give their text back (null texts give an empty one)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    decoded = bpe.decode_corpus(bpe.encode_corpus(documents)).withColumnRenamed("text", "decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return documents.join(decoded, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(same, 1)).alias("n_same"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lengths = bpe.encode_corpus(documents, lengths_only=True)
    return packing.pack_corpus(lengths, table(spark, sf_dir, "pack_capacities"), total=documents.count())


@REGISTRY.add("p6_packed")
def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a container of each capacity."""
    return _packed(spark, sf_dir)


@REGISTRY.add("p6_report")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    return packing.fill_report(_packed(spark, sf_dir), table(spark, sf_dir, "pack_capacities"))


@REGISTRY.add(
    "p6_checks",
    sql="""SELECT capacity_id, (SELECT count(*) FROM documents) AS n_documents, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_wrongly_divided, CAST(0 AS BIGINT) AS n_gaps
      FROM pack_capacities WHERE capacity_tokens >= 1""",
)
def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a packing: every document in it, no container overfull, no text divided that fits, no piece missing."""
    return packing.packing_checks(_packed(spark, sf_dir), table(spark, sf_dir, "pack_capacities"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return harm.score_corpus(documents, harm.fit(documents, table(spark, sf_dir, "review_labels")))


@REGISTRY.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one abusive, hateful or sexual line."""
    return _scored(spark, sf_dir).where("harmful").select("doc_id")


@REGISTRY.add("p7_scores")
def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; harmful above 0."""
    return _scored(spark, sf_dir)


@REGISTRY.add("p7_rates")
def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of such documents per source."""
    return harm.rates(_scored(spark, sf_dir))
