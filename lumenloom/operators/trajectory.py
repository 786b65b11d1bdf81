"""Trajectory audit: a wide row of measures per conversation, and summaries of such rows.

A conversation carries its crops, its evidence and its page sizes as arrays, so
every measure is an expression over one row: no join, no shuffle, and nothing
leaves the JVM. `collect` builds the arrays where the parts come as tables.

    crops     array<struct<source:int,page:int,box:array<double>>>, in order; source
              is the image a crop was cut from (its parent crop, else the page)
    evidence  array<struct<page:int,box:array<double>,scaled:boolean>>; box null for a page only
    sizes     map<int,array<double>>, page to width and height
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import geometry as G
from lumenloom.functions.values import bound, quantile, rate, share
from lumenloom.operators.summary import grouped_at_levels

CROPS = "array<struct<source:int,page:int,box:array<double>>>"
EVIDENCE = "array<struct<page:int,box:array<double>,scaled:boolean>>"
SIZES = "map<int,array<double>>"

#: Share of an evidence box a crop must hold to cover it, and overlap from which two crops are redundant.
COVERED, REDUNDANT = 0.5, 0.8
#: Size of a page in the units of evidence boxes, and how far beyond it a box must reach to be in pixels already.
PAGE_UNITS, IN_PIXELS = (612.0, 792.0), 1.2


def collect(conversations: DataFrame, crops: DataFrame, evidence: DataFrame, sizes: DataFrame, conv: str = "conv") -> DataFrame:
    """`conversations` with crops (conv, step, source, page, box), evidence (conv, page, box, scaled) and sizes (conv, page, width, height) as arrays.

    A conversation is short by nature, so its parts are held together. One
    without parts has empty arrays; of a page's sizes the largest is taken.
    """
    own = crops.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("step", "source", "page", "box"))).alias("c")).select(conv, F.transform("c", lambda x: F.struct(x["source"].cast("int").alias("source"), x["page"].cast("int").alias("page"), x["box"].alias("box"))).alias("crops"))
    seen = evidence.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "box", "scaled"))).alias("evidence"))
    pages = sizes.groupBy(conv, F.col("page").cast("int").alias("page")).agg(F.max(F.array("width", "height")).alias("s")).groupBy(conv).agg(F.map_from_entries(F.collect_list(F.struct("page", "s"))).alias("sizes"))
    return conversations.join(own, conv, "left").join(seen, conv, "left").join(pages, conv, "left")


def scaled_evidence(box: Column, size: Column, units: tuple[float, float] = PAGE_UNITS) -> Column:
    """struct(box, scaled): an evidence box in page units as one in pixels of the page's `size` [width, height].

    Left as it is without a size, and where it reaches so far beyond the page's
    units that it must be in pixels already.
    """
    width, height = F.get(size, F.lit(0)), F.get(size, F.lit(1))
    known = (width > 0) & (height > 0) & (F.greatest(F.get(box, F.lit(2)), F.get(box, F.lit(3))) <= max(units) * IN_PIXELS)
    factors = [width / units[0], height / units[1]] * 2
    moved = F.array(*[F.get(box, F.lit(i)) * factors[i] for i in range(4)])
    scales = F.coalesce(known, F.lit(False))
    return F.struct(F.when(scales, moved).otherwise(box).alias("box"), scales.alias("scaled"))


def page_of_input(images: Column) -> tuple[Column, Column]:
    """Of input images, array<struct<original_img_idx:int,path:string,original_size:array<double>>>: a map of input number to page, and one of page to size.

    An image's number is original_img_idx, else its place; its page is the whole
    number that its file name is, else its number. Of images with the same number
    or page the last counts; sizes that aren't two positive numbers are left out.
    """
    stem = lambda path: F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*?)(?:\.[^./]*)?$", 1).try_cast("int")
    each = F.transform(F.coalesce(images, F.array().cast("array<struct<original_img_idx:int,path:string,original_size:array<double>>>")), lambda x, i: F.struct(F.coalesce(x["original_img_idx"], i).alias("no"), stem(x["path"]).alias("stem"), x["original_size"].alias("size")))
    paged = F.transform(each, lambda x: F.struct(x["no"], F.coalesce(x["stem"], x["no"]).alias("page"), x["size"]))
    sized = F.filter(paged, lambda x: (F.size(x["size"]) == 2) & (F.get(x["size"], F.lit(0)) > 0) & (F.get(x["size"], F.lit(1)) > 0))

    def last(rows: Column, key: str, value: str) -> Column:
        kept = F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, i + 2, F.greatest(F.size(rows), F.lit(1))), lambda y: y[key] == x[key]))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x[key], x[value])))

    return last(paged, "no", "page"), last(sized, "page", "size")


def asked_pages(pages: Column, total: Column, source: Column, box_pages: Column) -> Column:
    """The pages a question names, counted from 0, within its document; sorted and distinct.

    Sources count from 1, but for dude where boxes are given or page 0 is named.
    """
    from_zero = (F.lower(source) == "dude") & ((F.size(box_pages) > 0) | F.array_contains(pages, 0))
    shifted = F.transform(pages, lambda p: F.when(F.coalesce(from_zero, F.lit(False)), p).otherwise(p - 1))
    return F.array_sort(F.array_distinct(F.filter(shifted, lambda p: (p >= 0) & (p < total))))


def input_pages(pages: Column, source: Column, field: str, start: Column, stems: Column) -> Column:
    """Pages that a benchmark names as places among the input images, sorted and distinct.

    longdocurl counts evidence pages from its slice's `start`, mmlongbench from 1,
    dude from 1 unless page 0 is named, others from 0; `stems` maps file stems to
    places, and pages no file name tells stay as they are.
    """
    zero = F.array_contains(pages, 0)
    moved = F.transform(
        pages,
        lambda p: F.when((source == "longdocurl") & F.lit(field == "evidence_pages"), p - F.coalesce(start, F.lit(0))).when(source == "mmlongbench", p - 1).when((source == "dude") & ~zero, p - 1).otherwise(p),
    )
    placed = F.transform(moved, lambda p: F.coalesce(F.try_element_at(stems, p), p))
    return F.array_sort(F.array_distinct(F.filter(placed, lambda p: p >= 0)))


def _first(steps: Column) -> Column:
    return F.array_min(F.filter(steps, lambda s: s > 0))


def trajectory_rows(conversations: DataFrame, calls: str = "tool_calls", limit: str = "tool_limit", covered: float = COVERED, redundant: float = REDUNDANT) -> DataFrame:
    """`conversations` (with crops, evidence and sizes) with all measures in place of the arrays.

    Measures that need something a conversation lacks are null: those of evidence
    boxes without one, of hits without a hit, of pairs without a pair, of the
    limit without one. Without a crop the zoomed shares are 0; with crops but no
    page size they are null. Null arrays count as empty.
    """
    start = conversations.withColumns({
        "_c": F.coalesce("crops", F.array().cast(CROPS)), "_e": F.coalesce("evidence", F.array().cast(EVIDENCE)),
        "_s": F.coalesce("sizes", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<array<double>>"))),
    })
    rows = start.withColumns({
        "_seen": F.transform("_c", lambda c: c["page"]), "_pages": F.array_distinct(F.transform("_e", lambda e: e["page"])), "_boxed": F.filter("_e", lambda e: e["box"].isNotNull()),
    }).withColumn("_box_pages", F.array_distinct(F.transform("_boxed", lambda e: e["page"])))

    def hit(c: Column, i: Column, e: Column) -> Column:
        inter = G.overlap(c["box"], e["box"])
        part = lambda whole: F.when(whole > 0, inter / whole).otherwise(F.lit(0.0))
        return F.struct((i + 1).alias("step"), c["page"].alias("page"), G.iou(c["box"], e["box"]).alias("iou"), part(G.area(e["box"])).alias("coverage"), part(G.area(c["box"])).alias("precision"))

    def clamped(c: Column) -> Column:
        size = F.try_element_at(F.col("_s"), c["page"])
        width, height = F.get(size, F.lit(0)), F.get(size, F.lit(1))
        return F.struct(c["page"].alias("page"), F.when(width * height > 0, G.clamp(c["box"], width, height)).alias("box"), F.when(width * height > 0, width * height).alias("whole"))

    def later(c: Column, i: Column) -> Column:
        same = F.filter(F.slice("_c", i + 2, F.greatest(F.size("_c"), F.lit(1))), lambda d: d["source"] == c["source"])
        return F.transform(same, lambda d: G.iou(c["box"], d["box"]))

    rows = rows.withColumns({
        "_hits": F.flatten(F.transform("_c", lambda c, i: F.transform(F.filter("_boxed", lambda e: e["page"] == c["page"]), lambda e: hit(c, i, e)))),
        "_at": F.transform("_pages", lambda p: F.array_position("_seen", p)),
        "_sized": F.transform("_c", clamped), "_ious": F.flatten(F.transform("_c", later)), "_back": F.reverse("_seen"),
    })
    rows = rows.withColumns({
        "_good": F.filter("_hits", lambda h: h["coverage"] >= covered), "_zoomed": F.filter("_sized", lambda z: z["box"].isNotNull()),
        "_other": bound(F.col("_back"), lambda back: F.array_position(F.transform(back, lambda p: p != F.get(back, F.lit(0))), True)),
    }).withColumn("_zoom_pages", F.array_distinct(F.transform("_zoomed", lambda z: z["page"])))
    n = F.size("_c")
    has_boxes, has_evidence = F.size("_boxed") > 0, F.size("_e") > 0
    best = lambda name: F.when(has_boxes, F.coalesce(F.array_max(F.transform("_hits", lambda h: h[name])), F.lit(0.0)))
    distinct = lambda name: F.size(F.array_distinct(F.transform("_good", lambda h: h[name])))
    box_pages_seen = F.size(F.array_intersect("_box_pages", "_seen"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    zoomed_area = total(F.transform("_zoom_pages", lambda p: bound(F.element_at("_s", p), lambda s: F.get(s, F.lit(0)) * F.get(s, F.lit(1)))))
    union = total(F.transform("_zoom_pages", lambda p: G.union_area(F.transform(F.filter("_zoomed", lambda z: z["page"] == p), lambda z: z["box"]))))
    summed = total(F.transform("_zoomed", lambda z: G.area(z["box"])))
    fractions = F.transform("_zoomed", lambda z: G.area(z["box"]) / z["whole"])
    any_zoom = F.size("_zoomed") > 0
    zoom = lambda value, none: F.when(n == 0, none).when(any_zoom, value)
    any_step = _first(F.col("_at")).cast("int")
    all_step = F.when((F.size("_pages") > 0) & F.forall("_at", lambda s: s > 0), F.array_max("_at")).cast("int")
    cover_step = F.array_min(F.transform("_good", lambda h: h["step"]))
    exhausted = F.col(calls) >= F.col(limit)
    run = F.when(F.col("_other") > 0, F.col("_other").cast("int") - 1).otherwise(n)
    measures = {
        "num_crops": n,
        "has_evidence": has_evidence, "has_evidence_pages": F.size("_pages") > 0, "has_evidence_boxes": has_boxes,
        "num_evidence_pages": F.size("_pages"), "num_evidence_boxes": F.size("_boxed"), "num_evidence_box_pages": F.size("_box_pages"),
        "num_cropped_evidence_box_pages": box_pages_seen, "num_cropped_evidence_box_pages_covered": distinct("page"),
        "num_crops_on_evidence_box_pages": F.size(F.filter("_seen", lambda p: F.array_contains("_box_pages", p))),
        "num_crops_hit_evidence_region_at_threshold": distinct("step"),
        "fraction_cropped_evidence_box_pages_covered": F.when(box_pages_seen > 0, distinct("page") / box_pages_seen),
        "num_scaled_evidence_boxes": F.size(F.filter("_boxed", lambda e: F.coalesce(e["scaled"], F.lit(False)))),
        "crop_hits_evidence_page": F.when(has_evidence, F.arrays_overlap("_pages", "_seen")),
        "max_crop_evidence_iou": best("iou"), "max_evidence_coverage": best("coverage"), "max_crop_precision_vs_evidence": best("precision"),
        "crop_covers_evidence_at_threshold": F.when(has_boxes, F.size("_good") > 0),
        "zoom_area_fraction_union": zoom(union / zoomed_area, F.lit(0.0)), "zoom_area_fraction_sum": zoom(summed / zoomed_area, F.lit(0.0)),
        "mean_crop_area_fraction_of_page": F.when(any_zoom, total(fractions) / F.size("_zoomed")), "max_crop_area_fraction_of_page": F.array_max(fractions),
        "num_zoomed_source_pages": F.size("_zoom_pages"), "num_crops_missing_page_size": F.size(F.filter("_sized", lambda z: z["whole"].isNull())),
        "first_any_evidence_page_hit_step": any_step, "first_all_evidence_pages_hit_step": all_step, "first_evidence_region_coverage_hit_step": cover_step,
        "tool_call_limit": F.col(limit), "exhausted_tool_call_limit": exhausted, "last_same_page_crop_run_length": run, "last_crop_page_id": F.get("_back", F.lit(0)),
        "stuck_exhausted_same_page_tail": F.when(exhausted.isNotNull(), exhausted & (run >= 2)),
        "same_source_img_crop_pairs": F.size("_ious"), "redundant_crop_pairs": F.size(F.filter("_ious", lambda v: v >= redundant)),
        "max_crop_pair_iou": F.array_max("_ious"), "mean_crop_pair_iou": F.when(F.size("_ious") > 0, total(F.col("_ious")) / F.size("_ious")),
    }
    rows = rows.withColumns(measures)
    for name in ("any_evidence_page_hit", "all_evidence_pages_hit", "evidence_region_coverage_hit"):
        step = F.col(f"first_{name}_step")
        rows = rows.withColumns({f"stopped_at_first_{name}": F.col("num_crops") == step, f"extra_crops_after_first_{name}": F.col("num_crops") - step})
    return rows.drop("crops", "evidence", "sizes", *[c for c in rows.columns if c.startswith("_")])


_SINCE = ("any_evidence_page_hit", "all_evidence_pages_hit", "evidence_region_coverage_hit")


def _mean(name: str, where: Column | None = None) -> Column:
    value = F.col(name).cast("double")
    value = F.when(~F.isnan(value), value)
    return F.avg(value if where is None else F.when(where, value))


def _rate(condition: Column, where: Column | None = None) -> Column:
    return rate(condition if where is None else F.when(where, condition))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _sum(name: str, where: Column | None = None) -> Column:
    value = F.coalesce(F.col(name), F.lit(0)).cast("bigint")
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0))


def _ratio(part: Column, whole: Column) -> Column:
    return share(part, F.when(whole != 0, whole))


def _at(name: str, q: float) -> Column:
    """Exact percentile of values rounded to six places, which bounds how many distinct ones a group has to hold."""
    return quantile(F.round(F.col(name).cast("double"), 6), q)


def shared_measures() -> dict[str, Column]:
    """The aggregates that both audits have."""
    n = F.col("num_crops")
    page, box = F.col("has_evidence_pages"), F.col("has_evidence_boxes")
    limited, exhausted, stuck = F.col("exhausted_tool_call_limit").isNotNull(), F.col("exhausted_tool_call_limit"), F.col("stuck_exhausted_same_page_tail")
    hit = "num_crops_hit_evidence_region_at_threshold"
    pages, pages_covered = _sum("num_cropped_evidence_box_pages"), _sum("num_cropped_evidence_box_pages_covered")
    out = {
        "rows": F.count(F.lit(1)), "rows_with_evidence": _count(F.col("has_evidence")), "rows_with_page_evidence": _count(page), "rows_with_box_evidence": _count(box),
        "rows_with_page_evidence_nonzero_crop": _count(page & (n > 0)), "rows_with_box_evidence_nonzero_crop": _count(box & (n > 0)),
        "mean_crops": _mean("num_crops"), "median_crops": _at("num_crops", 0.5), "p90_crops": _at("num_crops", 0.9), "total_crops": _sum("num_crops"), "zero_crop_fraction": _rate(n == 0),
        "crops_hit_evidence_region_at_threshold": _sum(hit), "box_evidence_total_crops": _sum("num_crops", box), "box_evidence_crops_hit_evidence_region_at_threshold": _sum(hit, box),
        "box_evidence_crop_evidence_region_hit_rate": _ratio(_sum(hit, box), _sum("num_crops", box)), "box_evidence_total_crops_per_evidence_region_hit_crop": _ratio(_sum("num_crops", box), _sum(hit, box)),
        "rows_with_tool_call_limit": _count(limited), "rows_exhausting_tool_call_limit": _count(exhausted), "tool_call_limit_exhaustion_rate": _rate(exhausted),
        "stuck_exhausted_same_page_tail_rows": _count(stuck), "stuck_exhausted_same_page_tail_rate": _rate(stuck, limited), "stuck_rate_among_tool_call_limit_exhausted": _rate(stuck, exhausted),
        "mean_last_same_page_crop_run_length": _mean("last_same_page_crop_run_length"),
        "mean_zoom_area_fraction_union": _mean("zoom_area_fraction_union"), "median_zoom_area_fraction_union": _at("zoom_area_fraction_union", 0.5), "p90_zoom_area_fraction_union": _at("zoom_area_fraction_union", 0.9),
        "mean_zoom_area_fraction_sum": _mean("zoom_area_fraction_sum"), "median_zoom_area_fraction_sum": _at("zoom_area_fraction_sum", 0.5), "p90_zoom_area_fraction_sum": _at("zoom_area_fraction_sum", 0.9),
        "mean_crop_area_fraction_of_page": _mean("mean_crop_area_fraction_of_page"), "mean_num_zoomed_source_pages": _mean("num_zoomed_source_pages"),
        "evidence_page_hit_rate": _rate(F.col("crop_hits_evidence_page"), page & (n > 0)), "evidence_coverage_hit_rate": _rate(F.col("crop_covers_evidence_at_threshold"), box & (n > 0)),
        "mean_max_evidence_coverage": _mean("max_evidence_coverage", box & (n > 0)), "mean_max_crop_evidence_iou": _mean("max_crop_evidence_iou", box & (n > 0)),
        "evidence_box_pages_hit_by_crops": pages, "evidence_box_pages_hit_by_crops_with_coverage": pages_covered, "evidence_box_page_coverage_hit_rate_on_cropped_pages": _ratio(pages_covered, pages),
        "mean_fraction_cropped_evidence_box_pages_covered": _mean("fraction_cropped_evidence_box_pages_covered"),
        "mean_max_crop_pair_iou": _mean("max_crop_pair_iou"), "rows_with_redundant_pair_rate": _rate(F.col("redundant_crop_pairs") > 0), "mean_redundant_pairs": _mean("redundant_crop_pairs"),
    }
    for name in _SINCE:
        among = F.col(f"first_{name}_step").isNotNull() & (box if "region" in name else page)
        out[f"rows_with_{name}"] = _count(among)
        out[f"stopped_at_first_{name}_fraction"] = _rate(F.col(f"stopped_at_first_{name}"), among)
        out[f"mean_extra_crops_after_first_{name}"] = _mean(f"extra_crops_after_first_{name}", among)
    return out


def training_summary(rows: DataFrame, levels: Sequence[Sequence[str]] = ((), ("difficulty",), ("subset",), ("source",))) -> DataFrame:
    """The audit of training conversations: all aggregates at every level in one pass. Needs is_unanswerable and the levels' columns."""
    unanswerable, evidence = F.coalesce("is_unanswerable", F.lit(False)), F.col("has_evidence")
    total, hit = _sum("num_crops"), _sum("num_crops_hit_evidence_region_at_threshold")
    answerable = F.greatest(_count(~unanswerable), F.lit(1))
    own = {
        "answerable_rows": _count(~unanswerable), "unanswerable_rows_excluded_from_evidence_metrics": _count(unanswerable),
        "answerable_rows_with_evidence": _count(~unanswerable & evidence), "answerable_rows_without_evidence": _count(~unanswerable & ~evidence),
        "answerable_rows_with_evidence_fraction": share(_count(~unanswerable & evidence), answerable), "answerable_rows_without_evidence_fraction": share(_count(~unanswerable & ~evidence), answerable),
        "crops_on_evidence_box_pages": _sum("num_crops_on_evidence_box_pages"), "crop_evidence_region_hit_rate": _ratio(hit, total), "total_crops_per_evidence_region_hit_crop": _ratio(total, hit),
    }
    return grouped_at_levels(rows, levels, {**shared_measures(), **own})


def export_summary(rows: DataFrame, levels: Sequence[Sequence[str]] = ((), ("rescale",), ("rescale", "benchmark"))) -> DataFrame:
    """The audit of exported conversations, rolled up: what both audits have, and rewards, times and tokens.

    Needs has_final_output_match, accuracy_reward, compute_score_success,
    tool_calls, n_valid_tool_calls, the times and the token counts.
    """
    n = F.col("num_crops")
    own = {
        "rows_with_final_output_match": _count(F.col("has_final_output_match")), "accuracy_reward_mean": _mean("accuracy_reward"), "compute_score_success_rate": _rate(F.col("compute_score_success")),
        **{f"crops_{i}": _count(n == i) for i in range(5)}, "crops_5_plus": _count(n >= 5),
        "mean_tool_call_messages": _mean("tool_calls"), "mean_valid_tool_calls": _mean("n_valid_tool_calls"),
        "mean_core_inference_time": _mean("core_inference_time"), "median_core_inference_time": _at("core_inference_time", 0.5), "p90_core_inference_time": _at("core_inference_time", 0.9),
        "mean_conversation_wall_time": _mean("conversation_wall_time"), "mean_prompt_tokens": _mean("prompt_tokens"), "mean_response_tokens_generated": _mean("response_tokens_generated"),
        "mean_response_tokens_tool": _mean("response_tokens_tool"), "mean_response_tokens_total": _mean("response_tokens_total"),
        "mean_total_tokens": F.avg((F.col("prompt_tokens") + F.col("response_tokens_total")).cast("double")),
    }
    return grouped_at_levels(rows, levels, {**shared_measures(), **own})
