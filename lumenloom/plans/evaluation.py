"""Queries of the evaluation, log and audit operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import geometry as G
from lumenloom.functions import text as T
from lumenloom.functions.values import clean_text, quantile, rate
from lumenloom.operators import audit, logs, summary
from lumenloom.plans.registry import Registry, table

REGISTRY = Registry()

NUMBERS = ("num_turns", "n_tool_calls", "wall_time_s", "prompt_tokens", "response_tokens_total", "total_tokens", "score")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that both engines' sums compare equal."""
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sample of every job, scored by exact match of its answer."""
    rows = table(spark, sf_dir, "checkpoint_rows").where("sample is not null")
    last = logs.latest_wins(rows.select("job_key", "line_id", "written_at", "sample"), ["job_key"], ["written_at", "line_id"])
    flat = last.select("job_key", "written_at", "sample.*")
    answer = clean_text(F.lower(T.tagged(F.col("solution_str"), "answer")))
    right = (answer == clean_text(F.lower("ground_truth"))).cast("double")
    return flat.withColumn("score", F.when(~F.coalesce("critical_failure", F.lit(False)), right)).withColumn("total_tokens", F.col("prompt_tokens") + F.col("response_tokens_total"))


SAMPLES = r"""
ranked AS (
  SELECT job_key, written_at, sample, row_number() OVER (PARTITION BY job_key ORDER BY written_at DESC NULLS LAST, line_id DESC) AS rn
  FROM checkpoint_rows WHERE sample IS NOT NULL AND job_key IS NOT NULL
), flat AS (SELECT job_key, written_at, unnest(sample) FROM ranked WHERE rn = 1
), samples AS (
  SELECT *, CASE WHEN NOT coalesce(critical_failure, false) THEN CAST(
      trim(lower(CASE WHEN regexp_matches(solution_str, '(?s)<answer>.*?</answer>') THEN regexp_extract(solution_str, '(?s)<answer>(.*?)</answer>', 1) END), E' \t\n\r')
      = trim(lower(ground_truth), E' \t\n\r') AS DOUBLE) END AS score,
    prompt_tokens + response_tokens_total AS total_tokens
  FROM flat
)"""

_MEANS = ", ".join(f"avg({c}) AS {c}_mean" for c in NUMBERS)
_PER_TRIAL = f"""per_trial AS (
  SELECT data_source, trial_idx, count(*) AS n, count(score) AS num_scored, count(*) FILTER (critical_failure) AS num_critical_failure,
    count(*) - count(score) - count(*) FILTER (critical_failure) AS num_unscored_noncritical, count(score) / count(*) AS valid_score_ratio, {_MEANS}
  FROM samples GROUP BY ALL)"""


def _round_sql(columns: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in columns)


_MEAN_NAMES = [f"{c}_mean" for c in NUMBERS]
_TRIAL_COLUMNS = ["data_source", "trial_idx", "n", "num_scored", "num_critical_failure", "num_unscored_noncritical", "valid_score_ratio", *_MEAN_NAMES]


def _by_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.group_summary(samples(spark, sf_dir), ["data_source", "trial_idx"], NUMBERS)


@REGISTRY.add("eval_summary_by_trial", sql=f"WITH {SAMPLES}, {_PER_TRIAL} SELECT {_round_sql(_TRIAL_COLUMNS, {'valid_score_ratio', *_MEAN_NAMES})} FROM per_trial")
def eval_summary_by_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and trial: counts, valid ratio and means."""
    return rounded(_by_trial(spark, sf_dir))


_LEVEL2 = ("valid_score_ratio", "score_mean", "total_tokens_mean", "wall_time_s_mean")


def _std(c: str) -> str:
    return f"round(CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END, 6)"


@REGISTRY.add(
    "eval_summary",
    sql=f"WITH {SAMPLES}, {_PER_TRIAL} SELECT data_source, count(*) AS num_trials, "
    + ", ".join(f"round(avg({c}), 6) AS {c}_mean, {_std(c)} AS {c}_std" for c in _LEVEL2)
    + " FROM per_trial GROUP BY data_source",
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: mean and deviation over trials of the trials' values."""
    return rounded(summary.over_trials(_by_trial(spark, sf_dir), ["data_source"], _LEVEL2))


@REGISTRY.add(
    "failure_summary",
    sql=f"""WITH {SAMPLES} SELECT data_source, CAST(grouping(data_source) AS BIGINT) AS level, count(*) AS n, count(*) FILTER (len(failure_reasons) > 0) AS num_failed,
      count(*) FILTER (critical_failure) AS num_critical, count(*) FILTER (score IS NULL AND NOT coalesce(critical_failure, false)) AS num_unscored_noncritical
      FROM samples GROUP BY GROUPING SETS ((), (data_source))""",
)
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed, critical and unscored samples, overall and per source."""
    return summary.failure_summary(samples(spark, sf_dir), "data_source")


_REASONS = f"{SAMPLES}, reasons AS (SELECT data_source, split_part(r, chr(10), 1) AS reason FROM (SELECT data_source, unnest(failure_reasons) AS r FROM samples) WHERE r IS NOT NULL)"
_KIND = r"""CASE WHEN trim(reason) = '' THEN 'unknown_failure' WHEN contains(lower(reason), 'timeout') THEN 'timeout'
  WHEN contains(lower(reason), 'rate limit') OR contains(lower(reason), '429') OR contains(lower(reason), 'too many requests') THEN 'rate_limit'
  WHEN contains(lower(reason), 'context') OR contains(lower(reason), 'max_model_len') OR contains(lower(reason), 'prompt is too long') THEN 'context_overflow'
  WHEN contains(lower(reason), 'empty') AND contains(lower(reason), 'assistant') THEN 'empty_assistant_message'
  WHEN contains(lower(reason), 'score') OR contains(lower(reason), 'judge') THEN split_part(trim(reason), ':', 1)
  WHEN contains(reason, ':') THEN array_to_string(list_filter(list_transform(string_split(trim(reason), ':'), lambda p: trim(p)), lambda p: p <> '')[1:2], ':')
  ELSE substr(trim(reason), 1, 96) END"""


@REGISTRY.add("failure_reason_rows", sql=f"WITH {_REASONS} SELECT data_source, reason, count(*) AS n FROM reasons GROUP BY ALL")
def failure_reason_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source gave each reason."""
    return summary.reasons(samples(spark, sf_dir), ["data_source"]).groupBy("data_source", "reason").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("failure_kinds", sql=f"WITH {_REASONS} SELECT {_KIND} AS kind, count(*) AS n FROM reasons GROUP BY ALL")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure reasons by kind, most frequent first."""
    return summary.reasons(samples(spark, sf_dir), []).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


_NO_REASON = "len(list_filter(coalesce(failure_reasons, []), lambda r: r IS NOT NULL AND r <> '')) = 0 AND NOT coalesce(critical_failure, false)"
_SWEEP = f"""WITH {SAMPLES}, marked AS (SELECT *, score IS NOT NULL AND {_NO_REASON} AS valid FROM samples), per AS (
  SELECT coalesce(trial_idx, 0) AS trial_idx, count(*) AS n_exported, count(DISTINCT sample_index) AS n_distinct, count(*) FILTER (valid) AS n_valid,
    sum(score) FILTER (valid) AS score_sum, avg(total_tokens) FILTER (valid) AS seq, avg(wall_time_s) FILTER (valid) AS wall FROM marked GROUP BY 1
), bounds AS (SELECT max(trial_idx) + 1 AS trials, max(n_exported) AS n_expected FROM per),
sweep AS (SELECT t.trial_idx, n_expected, coalesce(n_exported, 0) AS n_exported, greatest(0, n_expected - coalesce(n_distinct, 0)) AS n_missing, coalesce(n_valid, 0) AS n_valid,
  coalesce(n_valid, 0) / n_expected AS valid_ratio, score_sum / nullif(n_valid, 0) AS accuracy_valid, coalesce(score_sum, 0.0) / n_expected AS accuracy_expected, seq AS seq_len_mean, wall AS wall_time_mean,
  n_expected - coalesce(n_valid, 0) AS n_fail_or_missing FROM (SELECT CAST(unnest(range(trials)) AS INTEGER) AS trial_idx, n_expected FROM bounds) t LEFT JOIN per USING (trial_idx))"""
_SWEEP_DOUBLES = ("valid_ratio", "accuracy_valid", "accuracy_expected", "seq_len_mean", "wall_time_mean")


@REGISTRY.add("sweep_per_trial", sql=_SWEEP + " SELECT trial_idx, n_expected, n_exported, n_missing, n_valid, n_fail_or_missing, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SWEEP_DOUBLES) + " FROM sweep")
def sweep_per_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials of a sweep, those without rows included; how many there should be, and of how many samples, is taken from the data."""
    return rounded(summary.sweep_per_trial(samples(spark, sf_dir)))


@REGISTRY.add("sweep_summary", sql=_SWEEP + " SELECT count(*) AS num_trials, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, {_std(c)} AS {c}_std" for c in _SWEEP_DOUBLES) + " FROM sweep")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over the sweep's trials."""
    return rounded(summary.over_trials(summary.sweep_per_trial(samples(spark, sf_dir)), [], _SWEEP_DOUBLES))


@REGISTRY.add(
    "sweep_failures",
    sql=_SWEEP + f""", invalid AS (SELECT coalesce(list_filter(coalesce(failure_reasons, []), lambda r: r IS NOT NULL AND r <> '')[1], CASE WHEN critical_failure THEN 'critical_failure' END, 'invalid_or_unscored') AS reason FROM marked WHERE NOT valid),
      kinds AS (SELECT {_KIND} AS kind, 1 AS n FROM invalid UNION ALL SELECT 'missing_sample', n_missing FROM sweep WHERE n_missing > 0) SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM kinds GROUP BY 1""",
)
def sweep_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why samples of the sweep don't count, missing ones included."""
    rows = samples(spark, sf_dir)
    return summary.sweep_failures(rows, summary.sweep_per_trial(rows))


@REGISTRY.add("expected_counts", sql=f"WITH {SAMPLES}, c AS (SELECT trial_idx, count(*) AS n FROM samples GROUP BY 1) SELECT max(n) AS per_trial, max(n) * (max(trial_idx) + 1) AS in_all FROM c")
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples expected of a trial and in all, where no manifest says so."""
    per = samples(spark, sf_dir).groupBy("trial_idx").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("n").alias("per_trial"), (F.max("n") * (F.max("trial_idx") + 1)).alias("in_all"))


@REGISTRY.add("latest_wins", sql=f"WITH {SAMPLES} SELECT job_key, written_at, sample_index, trial_idx, wall_time_s FROM samples")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sample of each job by time, then line."""
    return samples(spark, sf_dir).select("job_key", "written_at", "sample_index", "trial_idx", "wall_time_s")


@REGISTRY.add(
    "latest_line_wins",
    sql="SELECT job_idx, line_id, written_at FROM checkpoint_rows WHERE job_idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_idx ORDER BY line_id DESC) = 1",
)
def latest_line_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each job, whatever its time says."""
    rows = table(spark, sf_dir, "checkpoint_rows").select("job_idx", "line_id", "written_at")
    return logs.latest_wins(rows, ["job_idx"], ["line_id"])


_SIDES = f"""{SAMPLES}, rollout AS (SELECT job_key, wall_time_s, CAST(NULL AS DOUBLE) AS score FROM samples WHERE sample_index IS NULL OR sample_index % 3 <> 0 OR sample_index % 2 = 1),
 judged AS (SELECT job_key, wall_time_s + 1 AS wall_time_s, score FROM samples WHERE sample_index % 2 = 0)"""


@REGISTRY.add(
    "merge_full_outer",
    sql=f"""WITH {_SIDES} SELECT coalesce(l.job_key, r.job_key) AS job_key, round(CASE WHEN l.job_key IS NULL THEN r.wall_time_s ELSE l.wall_time_s END, 6) AS wall_time_s,
      CASE WHEN l.job_key IS NULL THEN r.score ELSE coalesce(l.score, r.score) END AS score, r.job_key IS NULL AS is_new FROM rollout l FULL JOIN judged r ON l.job_key = r.job_key""",
)
def merge_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout and judged samples merged; the rollout's row wins, scores are taken over."""
    all_ = samples(spark, sf_dir)
    rollout = all_.where("sample_index is null or sample_index % 3 <> 0 or sample_index % 2 = 1").select("job_key", "wall_time_s", F.lit(None).cast("double").alias("score"))
    judged = all_.where("sample_index % 2 = 0").select("job_key", (F.col("wall_time_s") + 1).alias("wall_time_s"), "score")
    return rounded(logs.merge_judged(rollout, judged, "job_key"))


_JOBS_SQL = """jobs AS (SELECT row_id - 1 AS row_index, t.trial_idx, CAST(t.trial_idx * (SELECT count(*) FROM manifest) + row_id - 1 AS BIGINT) AS job_idx,
  sha256('{"resume_file_row_idx": ' || (row_id - 1) || ', "resume_val_file": "manifest.parquet", "trial_idx": ' || t.trial_idx || '}') AS job_key
  FROM manifest, (SELECT CAST(unnest(range(2)) AS INTEGER) AS trial_idx) t)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest").select((F.col("row_id") - 1).alias("row_index"), F.lit("manifest.parquet").alias("file"))
    return logs.job_matrix(rows, 2, "file", "row_index")


@REGISTRY.add("job_keys", sql=f"WITH {_JOBS_SQL} SELECT row_index, trial_idx, job_idx, job_key FROM jobs")
def job_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every manifest row twice, with its running job number and stable key."""
    return _jobs(spark, sf_dir).select("row_index", "trial_idx", "job_idx", "job_key")


_RESUME_SQL = f"""WITH {SAMPLES}, want AS (SELECT DISTINCT job_key FROM checkpoint_rows WHERE job_key IS NOT NULL
  UNION SELECT 'job-new-' || CAST(n_nationkey AS VARCHAR) FROM nation), classed AS (
  SELECT w.job_key, CASE WHEN s.job_key IS NULL THEN 'missing' WHEN coalesce(len(list_filter(failure_reasons, lambda r: r IS NOT NULL)) > 0, false) OR coalesce(critical_failure, false) THEN 'failed' ELSE 'reused' END AS state
  FROM want w LEFT JOIN samples s USING (job_key))"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "checkpoint_rows").where("job_key is not null").select("job_key").distinct()
    new = table(spark, sf_dir, "nation").select(F.concat(F.lit("job-new-"), F.col("n_nationkey").cast("string")).alias("job_key"))
    return logs.classify_jobs(known.union(new), samples(spark, sf_dir))


@REGISTRY.add("resume_left", sql=_RESUME_SQL + " SELECT job_key, state FROM classed")
def resume_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs are missing, failed or can be reused."""
    return _classified(spark, sf_dir).select("job_key", "state")


@REGISTRY.add("resume_counts", sql=_RESUME_SQL + " SELECT state, count(*) AS n FROM classed GROUP BY 1")
def resume_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs are missing, failed and reused."""
    return _classified(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add(
    "answers_extracted",
    sql=r"""SELECT line_id, CASE WHEN regexp_matches(sample.solution_str, '(?s)<think>.*?</think>') THEN regexp_extract(sample.solution_str, '(?s)<think>(.*?)</think>', 1) END AS think,
      CASE WHEN regexp_matches(sample.solution_str, '(?s)<answer>.*?</answer>') THEN regexp_extract(sample.solution_str, '(?s)<answer>(.*?)</answer>', 1) END AS answer FROM checkpoint_rows WHERE sample IS NOT NULL""",
)
def answers_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thought and answer taken from a solution's tags."""
    rows = table(spark, sf_dir, "checkpoint_rows").where("sample is not null")
    return rows.select("line_id", T.tagged(F.col("sample.solution_str"), "think").alias("think"), T.tagged(F.col("sample.solution_str"), "answer").alias("answer"))


CROPS = """crops AS (SELECT l_orderkey AS conv, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS step,
  CAST(l_suppkey % 4 AS INTEGER) AS page, l_quantity AS x1, 5.0 * l_linenumber AS y1, l_quantity + 10 + 100 * l_tax AS x2, 5.0 * l_linenumber + 10 + 100 * l_discount AS y2 FROM lineitem)"""
EVIDENCE = """evidence AS (SELECT o_orderkey AS conv, CAST((o_custkey + k) % 4 AS INTEGER) AS page, CAST(o_orderkey % 40 AS DOUBLE) AS x1, CAST(o_orderkey % 30 AS DOUBLE) AS y1,
  o_orderkey % 40 + 25.0 AS x2, o_orderkey % 30 + 20.0 AS y2 FROM orders, (SELECT unnest(range(2)) AS k))"""
_INTER = "(greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
_AREA = "(greatest(0.0, {a}.x2 - {a}.x1) * greatest(0.0, {a}.y2 - {a}.y1))"


def _iou_sql(a: str, b: str) -> str:
    inter = _INTER.format(a=a, b=b)
    union = f"({_AREA.format(a=a)} + {_AREA.format(a=b)} - {inter})"
    return f"CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0 END"


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the crops of a conversation: conv, step, page, box."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    line = F.col("l_linenumber") * 5.0
    box = F.array(F.col("l_quantity"), line, F.col("l_quantity") + 10 + 100 * F.col("l_tax"), line + 10 + 100 * F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conv"), F.row_number().over(order).cast("bigint").alias("step"), (F.col("l_suppkey") % 4).cast("int").alias("page"), box.alias("box"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evidence boxes for each order: conv, page, box."""
    key = F.col("o_orderkey")
    x, y = (key % 40).cast("double"), (key % 30).cast("double")
    rows = table(spark, sf_dir, "orders").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(key.alias("conv"), ((F.col("o_custkey") + F.col("k")) % 4).cast("int").alias("page"), F.array(x, y, x + 25.0, y + 20.0).alias("box"))


@REGISTRY.add("crop_pairs_iou", sql=f"WITH {CROPS} SELECT a.conv, a.page, a.step AS step_a, b.step AS step_b, round({_iou_sql('a', 'b')}, 6) AS iou FROM crops a JOIN crops b ON a.conv = b.conv AND a.page = b.page AND a.step < b.step")
def crop_pairs_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of crops taken from the same page."""
    return rounded(audit.crop_pairs(crops(spark, sf_dir)))


@REGISTRY.add(
    "crop_redundancy",
    sql=f"""WITH {CROPS}, p AS (SELECT a.conv, {_iou_sql("a", "b")} AS iou FROM crops a JOIN crops b ON a.conv = b.conv AND a.page = b.page AND a.step < b.step)
      SELECT conv, count(*) AS pairs, count(*) FILTER (iou >= 0.3) AS redundant, round(max(iou), 6) AS max_iou, round(avg(iou), 6) AS mean_iou FROM p GROUP BY conv""",
)
def crop_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundant crop pairs per conversation."""
    return rounded(audit.redundancy(crops(spark, sf_dir), 0.3))


@REGISTRY.add(
    "evidence_first_hit",
    sql=f"""WITH {CROPS}, {EVIDENCE}, p AS (SELECT e.conv, e.page, min(c.step) AS first, min(c.step) FILTER ({_INTER.format(a="c", b="e")} / nullif({_AREA.format(a="e")}, 0) >= 0.3) AS covered
      FROM evidence e LEFT JOIN crops c ON c.conv = e.conv AND c.page = e.page GROUP BY ALL), n AS (SELECT conv, max(step) AS n_crops FROM crops GROUP BY conv)
      SELECT p.conv, min(first) AS any_step, CASE WHEN count(first) = count(*) THEN max(first) END AS all_step, min(covered) AS cover_step, max(n_crops) - min(first) AS extra_after_any
      FROM p LEFT JOIN n ON n.conv = p.conv GROUP BY p.conv""",
)
def evidence_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which step a conversation reached its evidence."""
    return audit.first_hits(crops(spark, sf_dir), evidence(spark, sf_dir), 0.3)


_TAIL = f"""WITH {CROPS}, last AS (SELECT conv, max(step) AS n_crops, arg_max(page, step) AS last_page FROM crops GROUP BY conv), run AS (
  SELECT l.conv, n_crops, last_page, n_crops - coalesce(max(c.step) FILTER (c.page <> last_page), 0) AS run_length FROM last l JOIN crops c ON c.conv = l.conv GROUP BY l.conv, n_crops, last_page)"""


@REGISTRY.add("tail_run", sql=_TAIL + " SELECT conv, n_crops, last_page, run_length, n_crops >= tool_limit AS exhausted, CASE WHEN tool_limit IS NOT NULL THEN n_crops >= tool_limit AND run_length >= 2 END AS stuck FROM (SELECT *, CASE WHEN conv % 5 > 0 THEN conv % 5 END AS tool_limit FROM run)")
def tail_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops at a conversation's end that stay on one page, and whether it got stuck there."""
    runs = audit.tail_run(crops(spark, sf_dir)).withColumn("tool_limit", F.when(F.col("conv") % 5 > 0, F.col("conv") % 5))
    return audit.stuck(runs, "tool_limit").drop("tool_limit")


_PER_CONV = f"{CROPS}, per AS (SELECT o_orderkey AS conv, o_orderstatus AS difficulty, o_orderpriority AS subset, count(c.conv) AS n_crops, max(c.x2) AS reach FROM orders LEFT JOIN crops c ON c.conv = o_orderkey GROUP BY ALL)"
_AGG_SQL = "count(*) AS n, round(avg(n_crops), 6) AS mean_crops, round(quantile_cont(n_crops, 0.9), 6) AS p90_crops, round(avg(CAST(n_crops >= 5 AS DOUBLE)), 6) AS many_rate, round(avg(reach) FILTER (n_crops > 2), 6) AS mean_reach"


def _per_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = crops(spark, sf_dir).groupBy("conv").agg(F.count(F.lit(1)).alias("n_crops"), F.max(F.col("box")[2]).alias("reach"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv"), F.col("o_orderstatus").alias("difficulty"), F.col("o_orderpriority").alias("subset"))
    return orders.join(own, "conv", "left").withColumn("n_crops", F.coalesce("n_crops", F.lit(0)))


def _aggregates() -> dict:
    n = F.col("n_crops")
    return {"n": F.count(F.lit(1)), "mean_crops": F.avg(n), "p90_crops": quantile(n, 0.9), "many_rate": rate(n >= 5), "mean_reach": F.avg(F.when(n > 2, F.col("reach")))}


@REGISTRY.add("metrics_grouping_sets", sql=f"WITH {_PER_CONV} SELECT difficulty, subset, CAST(grouping(difficulty, subset) AS BIGINT) AS level, {_AGG_SQL} FROM per GROUP BY GROUPING SETS ((), (difficulty), (subset), (difficulty, subset))")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide aggregate overall, by difficulty, by subset and by both."""
    return rounded(summary.grouped_at_levels(_per_conv(spark, sf_dir), [[], ["difficulty"], ["subset"], ["difficulty", "subset"]], _aggregates()))


@REGISTRY.add("metrics_rollup", sql=f"WITH {_PER_CONV} SELECT difficulty, subset, CAST(grouping(difficulty, subset) AS BIGINT) AS level, {_AGG_SQL} FROM per GROUP BY ROLLUP (difficulty, subset)")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same aggregate rolled up."""
    return rounded(summary.grouped_at_levels(_per_conv(spark, sf_dir), [[], ["difficulty"], ["difficulty", "subset"]], _aggregates()))


@REGISTRY.add("bucket_histogram", sql=f"WITH {_PER_CONV} SELECT difficulty, " + ", ".join(f"count(*) FILTER (n_crops = {i}) AS bucket_{i}" for i in range(5)) + ", count(*) FILTER (n_crops >= 5) AS bucket_5_plus FROM per GROUP BY 1")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by number of crops, empty buckets kept."""
    return summary.histogram(_per_conv(spark, sf_dir), "n_crops", 5, ["difficulty"])


@REGISTRY.add("exact_percentiles", sql=f"WITH {SAMPLES} SELECT data_source, " + ", ".join(f"round(quantile_cont(wall_time_s, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95)) + " FROM samples GROUP BY 1")
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated percentiles of wall time."""
    aggs = [quantile(F.col("wall_time_s"), q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95)]
    return rounded(samples(spark, sf_dir).groupBy("data_source").agg(*aggs))


@REGISTRY.add(
    "describe_numbers",
    sql=f"""WITH {SAMPLES} SELECT trial_idx, count(total_tokens) AS n, round(avg(total_tokens), 6) AS mean, round(stddev_samp(total_tokens), 6) AS std, min(total_tokens) AS min,
      round(quantile_cont(total_tokens, 0.25), 6) AS q1, round(quantile_cont(total_tokens, 0.5), 6) AS median, round(quantile_cont(total_tokens, 0.75), 6) AS q3, max(total_tokens) AS max FROM samples GROUP BY 1""",
)
def describe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive statistics of token counts per trial."""
    return rounded(summary.describe(samples(spark, sf_dir), "total_tokens", ["trial_idx"]))


@REGISTRY.add(
    "weights_mass",
    sql="""SELECT CASE WHEN contains(source, '_unanswerable') THEN 'unanswerable' WHEN contains(source, '_answerable') THEN 'answerable' ELSE 'other' END AS answerability,
      regexp_replace(source, '_(un)?answerable.*$', '') AS category, count(*) AS n, round(sum(weight), 9) AS mass FROM mix_weights GROUP BY ALL""",
)
def weights_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight by answerability and category."""
    rows = table(spark, sf_dir, "mix_weights")
    grouped = rows.groupBy(T.answerability(F.col("source")).alias("answerability"), T.category(F.col("source")).alias("category"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 9).alias("mass"))


@REGISTRY.add(
    "crop_geometry",
    sql=f"""WITH {CROPS} SELECT conv, step, round({_AREA.format(a="crops")}, 6) AS area, round(least(100.0, x2) - greatest(0.0, x1), 6) AS clamped_width,
      CAST(greatest(0, least(1000, round_even(x1 * 1000.0 / 200.0, 0))) AS INTEGER) AS left_thousandths, CAST(greatest(1, round_even(x2 * 0.25, 0)) AS INTEGER) AS resized_width FROM crops""",
)
def crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, clamped, scaled and resized boxes."""
    box = F.col("box")
    hundred, two_hundred = F.lit(100.0), F.lit(200.0)
    cut = G.clamp(box, hundred, hundred)
    return rounded(crops(spark, sf_dir).select(
        "conv", "step", G.area(box).alias("area"), (cut[2] - cut[0]).alias("clamped_width"),
        G.to_thousandths(box, two_hundred, two_hundred)[0].alias("left_thousandths"), G.resize(box[2], box[3], F.lit(0.25))[0].alias("resized_width"),
    ))
