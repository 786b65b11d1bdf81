"""Evaluation summaries: per trial and over trials, failures, sweeps, grouping sets and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.samples import failure_reasons
from lumenloom.functions.text import failure_kind, first_line
from lumenloom.functions.values import deviation, mean, share


def group_summary(samples: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Per group: n, num_scored, num_critical_failure, num_unscored_noncritical, valid_score_ratio and the mean of each number.

    As n less scored less critical, num_unscored_noncritical is negative where a scored sample also failed critically.
    """
    n, scored, critical = F.count(F.lit(1)), F.count("score"), F.count(F.when(F.col("critical_failure"), 1))
    return samples.groupBy(*keys).agg(
        n.alias("n"), scored.alias("num_scored"), critical.alias("num_critical_failure"), (n - scored - critical).alias("num_unscored_noncritical"),
        share(scored, n).alias("valid_score_ratio"), *[mean(F.col(c)).alias(f"{c}_mean") for c in numbers],
    )


def over_trials(per_trial: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Second level: mean and deviation over the trials of each group (deviation 0.0 for one trial)."""
    stats = [f(F.col(c)).alias(f"{c}_{name}") for c in numbers for name, f in (("mean", mean), ("std", deviation))]
    return per_trial.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_trials"), *stats)


def reasons(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per failure reason of a sample: keys, reason (its first line), kind."""
    each = samples.select(*keys, F.explode("failure_reasons").alias("reason")).where(F.col("reason").isNotNull())
    return each.withColumn("reason", first_line(F.col("reason"))).withColumn("kind", failure_kind(F.col("reason")))


def unscored_failures(samples: DataFrame, source: str = "data_source") -> DataFrame:
    """Per source and reason the critical failures that have no score: data_source (unknown for null and empty), failure_reason (first line), count.

    A failure that lists no reason counts as critical_failure, one that lists
    several under each.
    """
    listed = F.when(F.size("failure_reasons") > 0, F.transform("failure_reasons", lambda r: F.coalesce(r, F.lit("None")))).otherwise(F.array(F.lit("critical_failure")))
    name = F.coalesce(F.when(F.col(source) != "", F.col(source)), F.lit("unknown"))
    rows = samples.where(F.col("score").isNull() & F.coalesce("critical_failure", F.lit(False))).select(name.alias("data_source"), F.explode(listed).alias("r"))
    return rows.groupBy("data_source", F.substring_index("r", "\n", 1).alias("failure_reason")).agg(F.count(F.lit(1)).alias("count")).orderBy("data_source", "failure_reason")


def failure_summary(samples: DataFrame, key: str) -> DataFrame:
    """Overall and per group: n, num_failed (with any reason), num_critical, num_unscored_noncritical; `level` tells which."""
    sets = samples.groupingSets([[], [F.col(key)]], F.col(key))
    any_reason = F.coalesce(F.size("failure_reasons") > 0, F.lit(False))
    return sets.agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count(F.when(any_reason, 1)).alias("num_failed"),
        F.count(F.when(F.col("critical_failure"), 1)).alias("num_critical"),
        F.count(F.when(F.col("score").isNull() & ~F.coalesce("critical_failure", F.lit(False)), 1)).alias("num_unscored_noncritical"),
    )


def _counts(samples: DataFrame) -> Column:
    """Whether a sample counts in a sweep: it has a score, no listed reason of failure, and didn't fail critically."""
    listed = F.col("failure_reasons") if "failure_reasons" in samples.columns else F.lit(None).cast("array<string>")
    return F.col("score").isNotNull() & (F.size(failure_reasons(listed, F.col("critical_failure"), sweep=True)) == 0)


def sweep_per_trial(samples: DataFrame, keys: Sequence[str] = (), trials: int | None = None, expected: int | None = None) -> DataFrame:
    """Per trial, present or not: exported, missing and valid samples, valid ratio, accuracy over valid and over expected samples, means over valid ones.

    A manifest's `trials` and `expected` (samples of a trial) are taken if given;
    else there are as many trials as the highest trial_idx tells and each should
    have as many samples as the largest has, found in the same pass over the
    per-trial counts. The trial dimension is generated, so a trial without rows
    still has its row. Null trial_idx counts as 0. A sample is valid if it has a
    score and no reason to fail.
    """
    rows = samples.withColumns({"_valid": _counts(samples), "trial_idx": F.coalesce("trial_idx", F.lit(0))})
    valid = F.col("_valid")
    per = rows.groupBy(*keys, "trial_idx").agg(
        F.count(F.lit(1)).alias("n_exported"), F.count_distinct("sample_index").alias("n_distinct"), F.count(F.when(valid, 1)).alias("n_valid"),
        F.sum(F.when(valid, F.col("score"))).alias("score_sum"), mean(F.when(valid, F.col("total_tokens"))).alias("seq_len_mean") if "total_tokens" in samples.columns else F.lit(None).cast("double").alias("seq_len_mean"),
        mean(F.when(valid, F.col("wall_time_s"))).alias("wall_time_mean"),
    )
    bounds = per.groupBy(*keys).agg(
        (F.lit(trials) if trials is not None else F.max("trial_idx") + 1).alias("_trials"), (F.lit(expected).cast("bigint") if expected is not None else F.max("n_exported")).alias("n_expected")
    )
    frame = bounds.select(*keys, "n_expected", F.explode(F.sequence(F.lit(0), F.col("_trials") - 1)).alias("trial_idx"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = F.coalesce(F.when(F.col("n_expected") > 0, F.col("n_expected")), F.when(zero("n_exported") > 0, F.col("n_exported")), F.lit(1))
    return frame.join(per, [*keys, "trial_idx"], "left").select(
        *keys, "trial_idx", "n_expected", zero("n_exported").alias("n_exported"), F.greatest(F.lit(0), F.col("n_expected") - zero("n_distinct")).alias("n_missing"), zero("n_valid").alias("n_valid"),
        share(zero("n_valid"), whole).alias("valid_ratio"), share(F.col("score_sum"), F.col("n_valid")).alias("accuracy_valid"),
        share(F.coalesce("score_sum", F.lit(0.0)), whole).alias("accuracy_expected"), "seq_len_mean", "wall_time_mean", (whole - zero("n_valid")).alias("n_fail_or_missing"),
    )


def sweep_failures(samples: DataFrame, per_trial: DataFrame) -> DataFrame:
    """kind, n: why samples of a sweep don't count, by the kind of their first reason (invalid_or_unscored without one), and those that are missing."""
    reasons_ = failure_reasons(F.col("failure_reasons"), F.col("critical_failure"), sweep=True)
    first = F.get(reasons_, F.lit(0))
    invalid = samples.where(~_counts(samples)).select(failure_kind(F.coalesce(first, F.lit("invalid_or_unscored"))).alias("kind"), F.lit(1).cast("bigint").alias("n"))
    missing = per_trial.where("n_missing > 0").select(F.lit("missing_sample").alias("kind"), F.col("n_missing").cast("bigint").alias("n"))
    return invalid.unionByName(missing).groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind")


def histogram(rows: DataFrame, value: str, last: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of the values 0, 1, ... and of those of `last` and more, zeros kept, in one pass: bucket_0 ... bucket_<last>_plus."""
    buckets = [F.count(F.when(F.col(value) == i, 1)).alias(f"bucket_{i}") for i in range(last)]
    return rows.groupBy(*keys).agg(*buckets, F.count(F.when(F.col(value) >= last, 1)).alias(f"bucket_{last}_plus"))


def grouped_at_levels(rows: DataFrame, levels: Sequence[Sequence[str]], aggregates: Mapping[str, Column]) -> DataFrame:
    """The same aggregates at several levels in one pass; `level` is the grouping id, which tells a null group from a subtotal."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    return rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("level"), *[v.alias(k) for k, v in aggregates.items()])


def describe(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (sample, null for one row), min, exact quartiles and max of a number."""
    v = F.col(value)
    quart = [F.percentile(v, F.lit(q)).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *quart, F.max(v).alias("max"))
