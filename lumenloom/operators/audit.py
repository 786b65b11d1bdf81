"""Trajectory audit: crops of a conversation against each other and against evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import geometry as G


def crop_pairs(crops: DataFrame, conv: str = "conv", source: str = "page", step: str = "step", box: str = "box") -> DataFrame:
    """Pairs of crops of one conversation and source image, earlier first: conv, page, step_a, step_b, iou.

    An equi-join on (conversation, source) with an order condition; the two
    sides are the same exchange, which Spark shuffles once.
    """
    a = crops.select(conv, source, F.col(step).alias("step_a"), F.col(box).alias("box_a"))
    b = crops.select(conv, source, F.col(step).alias("step_b"), F.col(box).alias("box_b"))
    return a.join(b, [conv, source]).where("step_a < step_b").select(conv, source, "step_a", "step_b", G.iou(F.col("box_a"), F.col("box_b")).alias("iou"))


def redundancy(crops: DataFrame, threshold: float, conv: str = "conv") -> DataFrame:
    """Per conversation with such pairs: same-source pairs, redundant ones (iou at or above the threshold), max and mean iou."""
    pairs = crop_pairs(crops, conv)
    return pairs.groupBy(conv).agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("iou") >= threshold, 1)).alias("redundant"), F.max("iou").alias("max_iou"), F.avg("iou").alias("mean_iou"))


def first_hits(crops: DataFrame, evidence: DataFrame, threshold: float, conv: str = "conv", page: str = "page") -> DataFrame:
    """Per conversation with evidence: first step on any evidence page, step by which all were seen, first covering step, crops after the first hit.

    All pages are seen at the latest of the pages' first steps, and only if every page has one.
    """
    pages = evidence.groupBy(conv, page).agg(F.collect_list("box").alias("boxes"))
    total = crops.groupBy(conv).agg(F.max("step").alias("n_crops"))
    covers = F.exists("boxes", lambda b: F.try_divide(G.overlap(F.col("box"), b), G.area(b)) >= threshold)
    per_page = pages.join(crops.select(conv, page, "step", "box"), [conv, page], "left").groupBy(conv, page).agg(F.min("step").alias("first"), F.min(F.when(covers, F.col("step"))).alias("covered"))
    hits = per_page.groupBy(conv).agg(
        F.min("first").alias("any_step"), F.when(F.count("first") == F.count(F.lit(1)), F.max("first")).alias("all_step"), F.min("covered").alias("cover_step")
    )
    return hits.join(total, conv, "left").select(conv, "any_step", "all_step", "cover_step", (F.col("n_crops") - F.col("any_step")).alias("extra_after_any"))


def tail_run(crops: DataFrame, conv: str = "conv", page: str = "page") -> DataFrame:
    """Per conversation: number of crops, the last one's page, and how many crops at the end stay on it.

    The last page comes from a window, the last crop elsewhere from an aggregate; no list of crops is built.
    """
    end = Window.partitionBy(conv).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = crops.select(conv, page, "step").withColumn("last_page", F.last(page).over(end))
    return known.groupBy(conv, "last_page").agg(F.max("step").alias("n_crops"), F.coalesce(F.max(F.when(F.col(page) != F.col("last_page"), F.col("step"))), F.lit(0)).alias("_other")).select(
        conv, "n_crops", "last_page", (F.col("n_crops") - F.col("_other")).alias("run_length")
    )


def stuck(runs: DataFrame, limit: str, calls: str = "n_crops") -> DataFrame:
    """Adds exhausted (calls at or over the limit) and stuck (exhausted on a run of two or more); both null without a limit."""
    exhausted = F.col(calls) >= F.col(limit)
    return runs.withColumn("exhausted", exhausted).withColumn("stuck", F.when(exhausted.isNotNull(), exhausted & (F.col("run_length") >= 2)))
