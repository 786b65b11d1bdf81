"""Mixing sources to target weights with capped repetition.

The size of a source is its number of records, so a block is a fixed number of
record slots. Every output shard draws its source counts at random from what is
left of the sources' quotas (a multinomial draw conditioned on the totals, so
the final shares are exact), each slot of a source is sent through a
pseudorandom permutation of that source's record indexes, and blocks meet their
records by an equi-join on (source, index).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of an output shard, and of a region of shards; exact draws need fewer than 1e9 slots in a region.
SHARD_SLOTS, REGION_SLOTS = 50_000, 500_000_000
#: Most sources; the driver holds one row for each.
MOST_SOURCES = 10_000
#: Records of a source that are numbered together by one task.
NUMBERED_TOGETHER = 50_000


def source_key(source: Column) -> Column:
    """A source's name without case, blanks at the ends and the difference between - and _."""
    return F.translate(F.lower(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", "")), "-", "_")


def mix_plan(rows: DataFrame, weights: DataFrame, source: str = "data_source") -> DataFrame:
    """One row per source of `weights`: what it should and what it can give.

    Result: source (as written in `weights`), key, weight, max_repeats, n_rows,
    total (rows of all weighted sources), quota (weight * total, a double), cap
    (max_repeats * n_rows), feasible (quota <= cap) and target (whole records;
    fractions are rounded so that the targets of all sources differ from the
    total by less than one record in all, largest fractions first) and planned
    (the target, at most the cap). Null weights and repeats count as 0. Rows of
    other sources, or of none, are left out. With no rows, all is 0.

    One partial aggregation over the rows' source column; the rest has one row
    per source.
    """
    counts = rows.where(F.col(source).isNotNull()).groupBy(source_key(F.col(source)).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    everything = Window.partitionBy()
    wanted = weights.select(
        F.col("source"), source_key(F.col("source")).alias("key"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")
    )
    plan = (
        wanted.join(counts, "key", "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint")))
        .withColumn("total", F.sum("n_rows").over(everything))
        .withColumn("quota", F.col("weight") * F.col("total"))
        .withColumn("cap", F.col("max_repeats") * F.col("n_rows"))
        .withColumn("feasible", F.col("quota") <= F.col("cap"))
    )
    fraction = F.col("quota") - F.floor("quota")
    missing = F.round(F.sum("quota").over(everything)) - F.sum(F.floor("quota")).over(everything)
    rounded = F.row_number().over(everything.orderBy(fraction.desc(), F.col("key")))
    return plan.withColumns({"_rank": rounded, "_missing": missing}).withColumn("target", (F.floor("quota") + F.when(F.col("_rank") <= F.col("_missing"), 1).otherwise(0)).cast("bigint")).drop("_rank", "_missing").withColumn("planned", F.least("target", F.col("cap").cast("bigint")))


def mix_report(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """Target and actual share of each source, the actual one counted in the mix.

    Result: source, n_rows, max_repeats, target_share, target, actual (slots the
    mix gave the source), actual_share (of all slots of the mix), share_of_target
    (of the wanted total, which sources that can't reach their share leave
    unfilled), most_used (how often the source's most used record is used),
    feasible.
    """
    placed = mixed.groupBy("source", "repeat").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum("n").alias("n"), (F.max("repeat") + 1).alias("most_used"))
    joined = plan.join(placed, plan["source"].eqNullSafe(placed["source"]), "left").drop(placed["source"]).withColumn("actual", F.coalesce("n", F.lit(0).cast("bigint")))
    whole = F.sum("actual").over(Window.partitionBy())
    share = lambda total: F.coalesce(F.try_divide(F.col("actual").cast("double"), total.cast("double")), F.lit(0.0))
    return joined.select(
        "source", "n_rows", "max_repeats", F.col("weight").alias("target_share"), "target", "actual", share(whole).alias("actual_share"),
        share(F.col("total")).alias("share_of_target"), F.coalesce("most_used", F.lit(0)).alias("most_used"), "feasible",
    )


def short_sources(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """source: those that can't reach their share, by what the mix placed.

    A source is short if the mix used each of its records as often as allowed
    (it placed max_repeats * n_rows slots) and that is still less than its exact
    quota, which is compared as a double, so that rounding to whole records
    decides no case.
    """
    report = mix_report(plan, mixed).select(F.col("source").alias("_source"), "actual")
    return plan.join(report, plan["source"].eqNullSafe(F.col("_source"))).where((F.col("actual") >= F.col("cap")) & (F.col("quota") > F.col("actual"))).select("source")


def permute(position: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of range(size), applied to positions; element by element.

    A Feistel network of six rounds over the smallest even number of bits that
    holds `size`, repeated for values that fall outside (cycle walking), which
    keeps it a bijection for every size.
    """
    x = position.astype(np.uint64)
    n = size.astype(np.uint64)
    k = key.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(2, size.astype(np.float64))) / 2)).astype(np.uint64)
    half = np.where((np.uint64(1) << (half * np.uint64(2))) < n, half + np.uint64(1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            v, h, m, kk = out[todo], half[todo], mask[todo], k[todo]
            left, right = v >> h, v & m
            for turn in range(6):
                f = (right + kk + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(31)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: str, source: str = "data_source", total: int | None = None) -> DataFrame:
    """key, index, `order`: the rows of each source numbered from 0 without gaps.

    Rows are spread over buckets by a hash of `order`, numbered inside (source,
    bucket) and shifted by the counts of the buckets before, so no source is
    sorted in one task however large it is. The counts are joined by merging, as
    the rows already lie in that order and counts grow with the rows. `total` (about how many rows there
    are) saves a count.
    """
    buckets = max(1, math.ceil((rows.count() if total is None else total) / NUMBERED_TOGETHER))
    keyed = rows.where(F.col(source).isNotNull()).select(source_key(F.col(source)).alias("key"), F.pmod(F.xxhash64(F.col(order), F.lit(7)), F.lit(buckets)).alias("bucket"), F.col(order))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("key", "bucket").orderBy(order)
    return keyed.withColumn("at", F.row_number().over(inside) - 1).join(offsets.hint("merge"), ["key", "bucket"]).select("key", (F.col("offset") + F.col("at")).alias("index"), order)


class Shards:
    """The source counts of output shards, drawn at random so that they add up to the planned totals.

    The planned slots are first divided evenly over regions of at most
    REGION_SLOTS. Inside a region the shards are halved again and again, and at
    each halving the left half draws its counts from what the region has there:
    a multivariate hypergeometric draw, which is the multinomial draw given the
    totals. A draw is seeded by its place, so every shard can be drawn alone, by
    any task, in as many draws as it has halvings above it.
    """

    def __init__(self, planned: list[int], seed: int, slots: int = SHARD_SLOTS, region: int = REGION_SLOTS) -> None:
        self.planned = np.array(planned, dtype=np.int64)
        self.seed, self.slots = seed, max(1, slots)
        total = int(self.planned.sum())
        self.regions = max(1, math.ceil(total / region))
        # Python's whole numbers, as the products may not fit 64 bits.
        self.bounds = [np.array([int(n) * r // self.regions for n in self.planned], dtype=np.int64) for r in range(self.regions + 1)]
        sizes = [int((b - a).sum()) for a, b in zip(self.bounds, self.bounds[1:])]
        self.first = [0]
        for size in sizes:
            self.first.append(self.first[-1] + math.ceil(size / self.slots))

    def __len__(self) -> int:
        return self.first[-1]

    def draw(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots that each source has in a shard, and the number of the first of them among the source's slots."""
        at = bisect_right(self.first, shard) - 1
        used = self.bounds[at].copy()
        counts = self.bounds[at + 1] - self.bounds[at]
        low, high = self.first[at], self.first[at + 1]
        while high - low > 1:
            middle = (low + high) // 2
            random = np.random.default_rng((self.seed, at, low, high))
            left = random.multivariate_hypergeometric(counts, (middle - low) * self.slots, method="marginals")
            if shard < middle:
                counts, high = left, middle
            else:
                used, counts, low = used + left, counts - left, middle
        return counts, used


def _seed_of(*parts: int) -> int:
    """A 62-bit number from whole numbers, the same in every process."""
    return int(np.random.SeedSequence(parts).generate_state(1, np.uint64)[0] >> np.uint64(2))


def shard_slots(shards: Shards, shard: int, n_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slot in the shard, number of the source, repeat, and index of the record, of every slot of a shard."""
    counts, first = shards.draw(shard)
    size = int(counts.sum())
    source = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(size) - np.repeat(np.cumsum(counts) - counts, counts)
    slot_of_source = first[source] + inside
    rows = n_rows[source]
    repeat = slot_of_source // rows
    # One key for each source and repeat, so that every pass over a source has an order of its own.
    pairs, which = np.unique(source * (int(repeat.max(initial=0)) + 1) + repeat, return_inverse=True)
    width = int(repeat.max(initial=0)) + 1
    keys = np.array([_seed_of(shards.seed, 1, int(p) // width, int(p) % width) for p in pairs], dtype=np.int64)
    index = permute(slot_of_source % rows, rows, keys[which] if size else np.zeros(0, np.int64))
    slot = permute(np.arange(size), np.full(size, size), np.full(size, _seed_of(shards.seed, 2, shard)))
    return slot, source, repeat, index


def mix(rows: DataFrame, weights: DataFrame, seed: int = 17, order: str = "row_id", source: str = "data_source", slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, slot, source, repeat, `order` of the record in the slot.

    Each source fills exactly its planned number of slots (`mix_plan`); none of
    its records is used more often than another by more than one, nor more than
    max_repeats times. Slots of a shard are in pseudorandom order. Sources that
    can't reach their share give all they may and are not replaced, so the mix is
    smaller by what they lack; `mix_report` tells both shares. The result depends
    only on the data and `seed`. Rows with a null `order` are numbered as any.

    The driver holds one row per source. Counts are drawn and slots permuted in
    the tasks, one shard after another; the only shuffles number the records and
    join them with their slots by (source, index), which no two records share;
    neither side is broadcast, as both have as many rows as the mix.
    """
    spark = rows.sparkSession
    plan = mix_plan(rows, weights, source).select("source", "key", "n_rows", "planned").orderBy("key").limit(MOST_SOURCES + 1).collect()
    if len(plan) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    shards = Shards([p.planned for p in plan], seed, slots)
    n_rows = np.array([max(1, p.n_rows) for p in plan], dtype=np.int64)
    names, keys = pa.array([p.source for p in plan], pa.string()), pa.array([p.key for p in plan], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                slot, of, repeat, index = shard_slots(shards, shard, n_rows)
                at = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), shard), pa.int64()), pa.array(slot, pa.int64()), names.take(at), keys.take(at), pa.array(repeat, pa.int32()), pa.array(index, pa.int64())],
                    ["shard", "slot", "source", "key", "repeat", "index"],
                )

    numbers = spark.range(0, len(shards), numPartitions=max(1, min(len(shards), 10_000)))
    wanted = numbers.mapInArrow(run, "shard bigint, slot bigint, source string, key string, repeat int, index bigint")
    # Spark takes the slots for as small as the list of shards they are drawn for, so without the hint it would broadcast them all.
    return wanted.join(numbered(rows, order, source, sum(p.n_rows for p in plan)).hint("merge"), ["key", "index"]).select("shard", "slot", "source", "repeat", order)
