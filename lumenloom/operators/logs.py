"""Append-only rollout logs: compaction, merging with judged samples, resuming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.samples import needs_rerun
from lumenloom.functions.values import job_key


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order`; rows with a null key are left out, null order values count as first.

    One aggregation with partial maxima, so a key with very many rows is
    reduced before the shuffle and no group is sorted. Rows that are equal in
    all of `order` are told apart by their other columns' hash.
    """
    known = rows
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c not in keys]
    hashed = [F.to_json(F.col(c)) if "map<" in kind else F.col(c) for c, kind in rows.dtypes if c in rest and c not in order]
    newest = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*hashed) if hashed else F.lit(0)))
    return known.groupBy(*keys).agg(newest.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)


def merge_judged(rollout: DataFrame, judged: DataFrame, key: str, score: str = "score", rescore: bool = False) -> DataFrame:
    """Full outer merge by key: the rollout's row wins, its score is the judged one unless rescoring; rows of one side only are kept.

    Both sides must have the same columns. `is_new` tells rollout rows without a judged one.
    """
    left, right = rollout.alias("l"), judged.alias("r")
    both = left.join(right, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    pick = []
    for c in rollout.columns:
        ours, theirs = F.col(f"l.{c}"), F.col(f"r.{c}")
        if c == score:
            kept = ours if rescore else F.coalesce(ours, theirs)
            pick.append(F.when(F.col(f"l.{key}").isNull(), theirs).otherwise(kept).alias(c))
        else:
            pick.append(F.when(F.col(f"l.{key}").isNull(), theirs).otherwise(ours).alias(c))
    return both.select(*pick, F.col(f"r.{key}").isNull().alias("is_new"))


def job_matrix(rows: DataFrame, trials: int, file: str, row_index: str) -> DataFrame:
    """Every row once per trial, trial by trial: trial_idx, job_idx (trial * rows + position), job_key and the row's columns.

    The trials are exploded from a literal, so nothing is joined; `row_index`
    must number the rows from 0 without gaps.
    """
    n = rows.count()
    out = rows.withColumn("trial_idx", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))) if trials > 0 else F.explode(F.array().cast("array<int>")))
    return out.withColumn("job_idx", F.col("trial_idx") * F.lit(n) + F.col(row_index)).withColumn("job_key", job_key(F.col("trial_idx"), F.col(file), F.col(row_index)))


def classify_jobs(jobs: DataFrame, existing: DataFrame, key: str = "job_key", failed: Column | None = None) -> DataFrame:
    """Jobs with state: missing (no sample yet), failed (to be run again) or reused.

    Unless `failed` says otherwise, a sample has failed if it lists a reason, if
    it failed critically, or if its map of scores tells a reason.
    """
    if failed is None:
        has = lambda c: F.col(c) if c in existing.columns else None
        told = has("score") if dict(existing.dtypes).get("score", "").startswith("map<") else None
        failed = needs_rerun(F.col("failure_reasons"), has("critical_failure"), told)
    seen = existing.select(key, F.coalesce(failed, F.lit(False)).alias("_failed"))
    return jobs.join(seen, key, "left").withColumn("state", F.when(F.col("_failed").isNull(), "missing").when(F.col("_failed"), "failed").otherwise("reused")).drop("_failed")


def identity_changes(before: DataFrame, now: DataFrame, item: str = "item", size: str = "n") -> DataFrame:
    """What keeps a run from being resumed: items (files, trials) that are gone or hold less than before; growth is allowed.

    Both sides have one row per item with its size. Result: item, before, now,
    change (removed or shrunk). No row means that the run may go on.
    """
    a, b = before.select(F.col(item), F.col(size).alias("before")), now.select(F.col(item), F.col(size).alias("now"))
    joined = a.join(b, a[item].eqNullSafe(b[item]), "left").select(a[item], "before", "now")
    return joined.withColumn("change", F.when(F.col("now").isNull(), "removed").when(F.col("now") < F.col("before"), "shrunk")).where("change is not null")
