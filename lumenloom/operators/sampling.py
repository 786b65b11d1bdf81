"""Deterministic sampling, splitting, limits and first occurrences; independent of partitioning and order of input."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: Column, seed: int) -> Column:
    """A pseudorandom sort key: md5 of seed and key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by smallest shuffle key (a top-n, no full sort); all rows if there are fewer. Null keys come last."""
    return rows.withColumn("_k", shuffle_key(F.col(key), seed)).orderBy(F.asc_nulls_last("_k"), key).limit(n).drop("_k")


def split(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Adds `part`: val for the rows whose shuffle key falls into the lowest fraction of its range, else train. A map, without counting or sorting.

    Null keys are train.
    """
    bound = f"{math.floor(fraction * 16**8):08x}" if fraction < 1 else "g"
    return rows.withColumn("part", F.when(F.substring(shuffle_key(F.col(key), seed), 1, 8) < bound, "val").otherwise("train"))


def head_split_size(n: int, fraction: float) -> int:
    """Rows of the head that become validation: at least 1 and at most n - 1; none for n <= 1 or fraction <= 0."""
    return 0 if n <= 1 or fraction <= 0 else min(max(1, int(n * fraction)), n - 1)


def head_split(rows: DataFrame, order: Sequence[str], fraction: float) -> DataFrame:
    """Adds `part`: val for the first rows in `order`, as many as `head_split_size` says, else train.

    The border row is found by a top-n; rows are then compared with it, so nothing is numbered in one partition. `order` must be unique.
    """
    size = head_split_size(rows.count(), fraction)
    if size == 0:
        return rows.withColumn("part", F.lit("train"))
    border = rows.orderBy(*order).limit(size).agg(F.max(F.struct(*order)).alias("b")).first()["b"]
    return rows.withColumn("part", F.when(F.struct(*order) <= F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, border)]), "val").otherwise("train"))


def limit_per_group(rows: DataFrame, group: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts groups to n before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first_occurrence(rows: DataFrame, group: Column, order: Sequence[str]) -> DataFrame:
    """Adds `is_first`: whether the row is the first of its group in `order` (which must be unique). Null groups are one group."""
    first = rows.groupBy(group.alias("_g")).agg(F.min(F.struct(*order)).alias("_f"))
    tagged = rows.withColumn("_g", group)
    return tagged.join(first, tagged["_g"].eqNullSafe(first["_g"]), "left").withColumn("is_first", F.struct(*[tagged[c] for c in order]) == F.col("_f")).drop(tagged["_g"]).drop(first["_g"]).drop("_f")


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in pseudorandom order, which key and seed determine (a range sort; ties by key)."""
    return rows.withColumn("_k", shuffle_key(F.col(key), seed)).orderBy(F.asc_nulls_last("_k"), key).drop("_k")
