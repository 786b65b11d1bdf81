"""Queries of the trajectory audit, each with its SQL. Order lines stand for crops, orders for conversations and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import trajectory
from lumenloom.plans.evaluation import _AREA, _INTER, CROPS, _iou_sql, crops, rounded
from lumenloom.plans.registry import Registry, table

REGISTRY = Registry()

#: Width and height of the pages whose size is known.
_SIZES = {0: (80.0, 70.0), 1: (90.0, 70.0), 2: (100.0, 70.0)}


def _size(page) -> object:
    return F.create_map(*[F.lit(x) if not isinstance(x, tuple) else F.array(*map(F.lit, x)) for pair in _SIZES.items() for x in pair])[page]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: its dimensions, and crops, evidence and page sizes as arrays."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        key.alias("conv"), F.col("o_orderstatus").alias("difficulty"), F.col("o_orderpriority").alias("subset"), (F.col("o_custkey") % 5).cast("string").alias("source"),
        (key % 7 == 0).alias("is_unanswerable"), (key % 6).cast("int").alias("tool_calls"), F.when(key % 5 > 0, key % 5).cast("int").alias("tool_limit"),
        (key % 2 == 0).alias("has_final_output_match"), F.when(key % 9 > 0, (key % 3 == 0).cast("double")).alias("accuracy_reward"), F.when(key % 8 > 0, key % 4 != 0).alias("compute_score_success"),
        (key % 4).cast("int").alias("n_valid_tool_calls"), (F.col("o_totalprice") / 1000).alias("core_inference_time"), F.when(key % 10 > 0, F.col("o_totalprice") / 900).alias("conversation_wall_time"),
        F.when(key % 11 > 0, F.col("o_custkey")).alias("prompt_tokens"), (key % 700).alias("response_tokens_generated"), (key % 300).alias("response_tokens_tool"), F.when(key % 4 > 0, key % 1000).alias("response_tokens_total"),
    )
    own = crops(spark, sf_dir).withColumn("source", F.col("page") * 10 + F.col("step") % 2)
    x, y = (key % 40) * 7.0 + F.when(key % 11 == 0, 1000.0).otherwise(0.0), (key % 30) * 9.0
    raw = orders.where(key % 7 != 0).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        key.alias("conv"), ((F.col("o_custkey") + F.col("k")) % 4).cast("int").alias("page"), F.when((F.col("k") == 0) | (key % 3 != 0), F.array(x, y, x + 175.0, y + 180.0)).alias("raw")
    )
    moved = raw.withColumn("m", F.when(F.col("raw").isNotNull(), trajectory.scaled_evidence(F.col("raw"), _size(F.col("page")))))
    evidence = moved.select("conv", "page", "m.box", "m.scaled")
    sizes = orders.select(key.alias("conv"), F.explode(F.array(*[F.struct(F.lit(p).alias("page"), F.lit(w).alias("width"), F.lit(h).alias("height")) for p, (w, h) in _SIZES.items()])).alias("s")).select("conv", "s.*")
    return trajectory.collect(rows, own, evidence, sizes)


_BOX = ("x1", "y1", "x2", "y2")
_SCALE = {"x1": ("w", 612), "y1": ("h", 792), "x2": ("w", 612), "y2": ("h", 792)}
_SIZE_ROWS = ", ".join(f"({p}, {w}, {h})" for p, (w, h) in _SIZES.items())
_ROWS = f"""{CROPS}, shots AS (SELECT *, page * 10 + step % 2 AS source FROM crops), sizes(page, w, h) AS (VALUES {_SIZE_ROWS}),
  raw AS (SELECT o_orderkey AS conv, CAST((o_custkey + k) % 4 AS INTEGER) AS page, k = 0 OR o_orderkey % 3 <> 0 AS boxed, (o_orderkey % 40) * 7.0 + CASE WHEN o_orderkey % 11 = 0 THEN 1000.0 ELSE 0.0 END AS x, (o_orderkey % 30) * 9.0 AS y
    FROM orders, (SELECT unnest(range(2)) AS k) WHERE o_orderkey % 7 <> 0),
  units AS (SELECT raw.conv, raw.page, boxed, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, CAST(x + 175 AS DOUBLE) AS x2, CAST(y + 180 AS DOUBLE) AS y2, w, h FROM raw LEFT JOIN sizes USING (page)),
  marked AS (SELECT *, w IS NOT NULL AND greatest(x2, y2) <= 792 * 1.2 AS scaled FROM units),
  evid AS (SELECT conv, page, boxed, boxed AND scaled AS scaled, {", ".join(f"CASE WHEN scaled THEN {c} * {_SCALE[c][0]} / {_SCALE[c][1]} ELSE {c} END AS {c}" for c in _BOX)} FROM marked),
  hits AS (SELECT c.conv, c.step, c.page, {_iou_sql("c", "e")} AS iou, {_INTER.format(a="c", b="e")} / {_AREA.format(a="e")} AS coverage, coalesce({_INTER.format(a="c", b="e")} / nullif({_AREA.format(a="c")}, 0), 0) AS prec
    FROM shots c JOIN evid e ON c.conv = e.conv AND c.page = e.page WHERE e.boxed),
  hit AS (SELECT conv, max(iou) AS iou, max(coverage) AS coverage, max(prec) AS prec, count(DISTINCT page) FILTER (coverage >= 0.5) AS pages, count(DISTINCT step) FILTER (coverage >= 0.5) AS crops, min(step) FILTER (coverage >= 0.5) AS step FROM hits GROUP BY 1),
  ev AS (SELECT conv, count(DISTINCT page) AS pages, count(*) FILTER (boxed) AS boxes, count(DISTINCT page) FILTER (boxed) AS box_pages, count(*) FILTER (scaled) AS scaled FROM evid GROUP BY 1),
  pf AS (SELECT e.conv, e.page, e.boxed, min(c.step) AS first FROM (SELECT conv, page, bool_or(boxed) AS boxed FROM evid GROUP BY 1, 2) e LEFT JOIN shots c ON c.conv = e.conv AND c.page = e.page GROUP BY ALL),
  firsts AS (SELECT conv, min(first) AS any_step, CASE WHEN count(first) = count(*) THEN max(first) END AS all_step, count(first) FILTER (boxed) AS box_pages_seen FROM pf GROUP BY 1),
  onbox AS (SELECT c.conv, count(*) AS n FROM shots c JOIN (SELECT DISTINCT conv, page FROM evid WHERE boxed) e ON c.conv = e.conv AND c.page = e.page GROUP BY 1),
  cut AS (SELECT c.conv, c.step, c.page, w * h AS whole, greatest(0, least(w, x1)) AS x1, greatest(0, least(h, y1)) AS y1, greatest(0, least(w, x2)) AS x2, greatest(0, least(h, y2)) AS y2 FROM shots c JOIN sizes USING (page)),
  zc AS (SELECT * FROM cut WHERE x2 > x1 AND y2 > y1),
  xs AS (SELECT DISTINCT conv, page, x FROM (SELECT conv, page, x1 AS x FROM zc UNION ALL SELECT conv, page, x2 FROM zc)), ys AS (SELECT DISTINCT conv, page, y FROM (SELECT conv, page, y1 AS y FROM zc UNION ALL SELECT conv, page, y2 FROM zc)),
  xc AS (SELECT conv, page, x AS lo, lead(x) OVER (PARTITION BY conv, page ORDER BY x) AS hi FROM xs), yc AS (SELECT conv, page, y AS lo, lead(y) OVER (PARTITION BY conv, page ORDER BY y) AS hi FROM ys),
  cells AS (SELECT DISTINCT xc.conv, xc.page, xc.lo AS xl, xc.hi AS xh, yc.lo AS yl, yc.hi AS yh FROM xc JOIN yc ON xc.conv = yc.conv AND xc.page = yc.page JOIN zc c ON c.conv = xc.conv AND c.page = xc.page AND c.x1 <= xc.lo AND c.x2 >= xc.hi AND c.y1 <= yc.lo AND c.y2 >= yc.hi),
  unions AS (SELECT conv, sum((xh - xl) * (yh - yl)) AS covered FROM cells GROUP BY 1),
  zoom AS (SELECT conv, sum({_AREA.format(a="zc")}) AS summed, avg({_AREA.format(a="zc")} / whole) AS mean_part, max({_AREA.format(a="zc")} / whole) AS max_part, count(DISTINCT page) AS pages FROM zc GROUP BY 1),
  wholes AS (SELECT conv, sum(whole) AS whole FROM (SELECT DISTINCT conv, page, whole FROM zc) GROUP BY 1),
  counts AS (SELECT conv, max(step) AS n, arg_max(page, step) AS last_page, count(*) FILTER (page NOT IN (SELECT page FROM sizes)) AS unsized FROM shots GROUP BY 1),
  tails AS (SELECT l.conv, l.n - coalesce(max(c.step) FILTER (c.page <> last_page), 0) AS run FROM counts l JOIN shots c ON c.conv = l.conv GROUP BY l.conv, l.n, last_page),
  pairs AS (SELECT a.conv, count(*) AS n, count(*) FILTER ({_iou_sql("a", "b")} >= 0.8) AS redundant, max({_iou_sql("a", "b")}) AS max_iou, avg({_iou_sql("a", "b")}) AS mean_iou FROM shots a JOIN shots b ON a.conv = b.conv AND a.source = b.source AND a.step < b.step GROUP BY 1),
  base AS (SELECT o_orderkey AS conv, o_orderstatus AS difficulty, o_orderpriority AS subset, CAST(o_custkey % 5 AS VARCHAR) AS source, o_orderkey % 7 = 0 AS is_unanswerable, o_orderkey % 6 AS tool_calls,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS tool_limit, o_orderkey % 2 = 0 AS has_final_output_match, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey % 3 = 0 AS DOUBLE) END AS accuracy_reward,
    CASE WHEN o_orderkey % 8 > 0 THEN o_orderkey % 4 <> 0 END AS compute_score_success, o_orderkey % 4 AS n_valid_tool_calls, o_totalprice / 1000 AS core_inference_time, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice / 900 END AS conversation_wall_time,
    CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS prompt_tokens, o_orderkey % 700 AS response_tokens_generated, o_orderkey % 300 AS response_tokens_tool, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 1000 END AS response_tokens_total FROM orders),
  wide AS (SELECT b.*, coalesce(c.n, 0) AS num_crops, ev.conv IS NOT NULL AS has_evidence, ev.conv IS NOT NULL AS has_evidence_pages, coalesce(ev.boxes, 0) > 0 AS has_evidence_boxes,
    coalesce(ev.pages, 0) AS num_evidence_pages, coalesce(ev.boxes, 0) AS num_evidence_boxes, coalesce(ev.box_pages, 0) AS num_evidence_box_pages, coalesce(f.box_pages_seen, 0) AS num_cropped_evidence_box_pages,
    coalesce(hit.pages, 0) AS num_cropped_evidence_box_pages_covered, coalesce(onbox.n, 0) AS num_crops_on_evidence_box_pages, coalesce(hit.crops, 0) AS num_crops_hit_evidence_region_at_threshold,
    CASE WHEN f.box_pages_seen > 0 THEN coalesce(hit.pages, 0) / f.box_pages_seen END AS fraction_cropped_evidence_box_pages_covered, coalesce(ev.scaled, 0) AS num_scaled_evidence_boxes,
    CASE WHEN ev.conv IS NOT NULL THEN f.any_step IS NOT NULL END AS crop_hits_evidence_page, CASE WHEN ev.boxes > 0 THEN coalesce(hit.iou, 0.0) END AS max_crop_evidence_iou,
    CASE WHEN ev.boxes > 0 THEN coalesce(hit.coverage, 0.0) END AS max_evidence_coverage, CASE WHEN ev.boxes > 0 THEN coalesce(hit.prec, 0.0) END AS max_crop_precision_vs_evidence,
    CASE WHEN ev.boxes > 0 THEN coalesce(hit.coverage, 0.0) >= 0.5 END AS crop_covers_evidence_at_threshold,
    CASE WHEN c.n IS NULL THEN 0.0 ELSE u.covered / ws.whole END AS zoom_area_fraction_union, CASE WHEN c.n IS NULL THEN 0.0 ELSE z.summed / ws.whole END AS zoom_area_fraction_sum,
    z.mean_part AS mean_crop_area_fraction_of_page, z.max_part AS max_crop_area_fraction_of_page, coalesce(z.pages, 0) AS num_zoomed_source_pages, coalesce(c.unsized, 0) AS num_crops_missing_page_size,
    f.any_step AS first_any_evidence_page_hit_step, f.all_step AS first_all_evidence_pages_hit_step, hit.step AS first_evidence_region_coverage_hit_step, tool_limit AS tool_call_limit, b.tool_calls >= tool_limit AS exhausted_tool_call_limit,
    coalesce(t.run, 0) AS last_same_page_crop_run_length, c.last_page AS last_crop_page_id, CASE WHEN tool_limit IS NOT NULL THEN b.tool_calls >= tool_limit AND coalesce(t.run, 0) >= 2 END AS stuck_exhausted_same_page_tail,
    coalesce(p.n, 0) AS same_source_img_crop_pairs, coalesce(p.redundant, 0) AS redundant_crop_pairs, p.max_iou AS max_crop_pair_iou, p.mean_iou AS mean_crop_pair_iou
    FROM base b LEFT JOIN counts c USING (conv) LEFT JOIN ev USING (conv) LEFT JOIN hit USING (conv) LEFT JOIN firsts f USING (conv) LEFT JOIN onbox USING (conv) LEFT JOIN zoom z USING (conv)
    LEFT JOIN unions u USING (conv) LEFT JOIN wholes ws USING (conv) LEFT JOIN tails t USING (conv) LEFT JOIN pairs p USING (conv)),
  measured AS (SELECT *, {", ".join(f"num_crops = first_{n}_step AS stopped_at_first_{n}, num_crops - first_{n}_step AS extra_crops_after_first_{n}" for n in ("any_evidence_page_hit", "all_evidence_pages_hit", "evidence_region_coverage_hit"))} FROM wide)"""

_WHOLE = (
    "num_crops num_evidence_pages num_evidence_boxes num_evidence_box_pages num_cropped_evidence_box_pages num_cropped_evidence_box_pages_covered num_crops_on_evidence_box_pages num_crops_hit_evidence_region_at_threshold num_scaled_evidence_boxes "
    "num_zoomed_source_pages num_crops_missing_page_size first_any_evidence_page_hit_step first_all_evidence_pages_hit_step first_evidence_region_coverage_hit_step tool_call_limit last_same_page_crop_run_length last_crop_page_id "
    "same_source_img_crop_pairs redundant_crop_pairs extra_crops_after_first_any_evidence_page_hit extra_crops_after_first_all_evidence_pages_hit extra_crops_after_first_evidence_region_coverage_hit"
).split()
_FLAGS = (
    "has_evidence has_evidence_pages has_evidence_boxes crop_hits_evidence_page crop_covers_evidence_at_threshold exhausted_tool_call_limit stuck_exhausted_same_page_tail "
    "stopped_at_first_any_evidence_page_hit stopped_at_first_all_evidence_pages_hit stopped_at_first_evidence_region_coverage_hit"
).split()
_SHARES = (
    "fraction_cropped_evidence_box_pages_covered max_crop_evidence_iou max_evidence_coverage max_crop_precision_vs_evidence zoom_area_fraction_union zoom_area_fraction_sum mean_crop_area_fraction_of_page "
    "max_crop_area_fraction_of_page max_crop_pair_iou mean_crop_pair_iou"
).split()


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.trajectory_rows(conversations(spark, sf_dir))


def plain(rows: DataFrame) -> DataFrame:
    """Whole numbers as bigint and doubles to six places, for comparison."""
    return rounded(rows.select(*[F.col(c).cast("bigint").alias(c) if kind in ("int", "bigint") else F.col(c) for c, kind in rows.dtypes]))


@REGISTRY.add("trajectory_rows", sql=f"WITH {_ROWS} SELECT conv, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _WHOLE)}, {', '.join(_FLAGS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _SHARES)} FROM measured")
def trajectory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of every conversation."""
    return plain(_measured(spark, sf_dir).select("conv", *_WHOLE, *_FLAGS, *_SHARES))


def _avg(c: str, where: str = "true") -> str:
    return f"round(avg(CAST({c} AS DOUBLE)) FILTER ({where}), 6)"


def _n(where: str) -> str:
    return f"count(*) FILTER ({where})"


def _total(c: str, where: str = "true") -> str:
    return f"CAST(coalesce(sum({c}) FILTER ({where}), 0) AS BIGINT)"


def _per(part: str, whole: str) -> str:
    return f"round(CAST({part} AS DOUBLE) / nullif({whole}, 0), 6)"


def _pct(c: str, q: float) -> str:
    return f"round(quantile_cont(round(CAST({c} AS DOUBLE), 6), {q}), 6)"


_PAGE, _BOXED, _HIT = "has_evidence_pages", "has_evidence_boxes", "num_crops_hit_evidence_region_at_threshold"
_SHARED_SQL = {
    "rows": "count(*)", "rows_with_evidence": _n("has_evidence"), "rows_with_page_evidence": _n(_PAGE), "rows_with_box_evidence": _n(_BOXED),
    "rows_with_page_evidence_nonzero_crop": _n(f"{_PAGE} AND num_crops > 0"), "rows_with_box_evidence_nonzero_crop": _n(f"{_BOXED} AND num_crops > 0"),
    "mean_crops": _avg("num_crops"), "median_crops": _pct("num_crops", 0.5), "p90_crops": _pct("num_crops", 0.9), "total_crops": _total("num_crops"), "zero_crop_fraction": _avg("num_crops = 0"),
    "crops_hit_evidence_region_at_threshold": _total(_HIT), "box_evidence_total_crops": _total("num_crops", _BOXED), "box_evidence_crops_hit_evidence_region_at_threshold": _total(_HIT, _BOXED),
    "box_evidence_crop_evidence_region_hit_rate": _per(_total(_HIT, _BOXED), _total("num_crops", _BOXED)), "box_evidence_total_crops_per_evidence_region_hit_crop": _per(_total("num_crops", _BOXED), _total(_HIT, _BOXED)),
    "rows_with_tool_call_limit": _n("tool_limit IS NOT NULL"), "rows_exhausting_tool_call_limit": _n("exhausted_tool_call_limit"), "tool_call_limit_exhaustion_rate": _avg("exhausted_tool_call_limit"),
    "stuck_exhausted_same_page_tail_rows": _n("stuck_exhausted_same_page_tail"), "stuck_exhausted_same_page_tail_rate": _avg("stuck_exhausted_same_page_tail"),
    "stuck_rate_among_tool_call_limit_exhausted": _avg("stuck_exhausted_same_page_tail", "exhausted_tool_call_limit"), "mean_last_same_page_crop_run_length": _avg("last_same_page_crop_run_length"),
    "mean_zoom_area_fraction_union": _avg("zoom_area_fraction_union"), "median_zoom_area_fraction_union": _pct("zoom_area_fraction_union", 0.5), "p90_zoom_area_fraction_union": _pct("zoom_area_fraction_union", 0.9),
    "mean_zoom_area_fraction_sum": _avg("zoom_area_fraction_sum"), "median_zoom_area_fraction_sum": _pct("zoom_area_fraction_sum", 0.5), "p90_zoom_area_fraction_sum": _pct("zoom_area_fraction_sum", 0.9),
    "mean_crop_area_fraction_of_page": _avg("mean_crop_area_fraction_of_page"), "mean_num_zoomed_source_pages": _avg("num_zoomed_source_pages"),
    "evidence_page_hit_rate": _avg("crop_hits_evidence_page", f"{_PAGE} AND num_crops > 0"), "evidence_coverage_hit_rate": _avg("crop_covers_evidence_at_threshold", f"{_BOXED} AND num_crops > 0"),
    "mean_max_evidence_coverage": _avg("max_evidence_coverage", f"{_BOXED} AND num_crops > 0"), "mean_max_crop_evidence_iou": _avg("max_crop_evidence_iou", f"{_BOXED} AND num_crops > 0"),
    "evidence_box_pages_hit_by_crops": _total("num_cropped_evidence_box_pages"), "evidence_box_pages_hit_by_crops_with_coverage": _total("num_cropped_evidence_box_pages_covered"),
    "evidence_box_page_coverage_hit_rate_on_cropped_pages": _per(_total("num_cropped_evidence_box_pages_covered"), _total("num_cropped_evidence_box_pages")),
    "mean_fraction_cropped_evidence_box_pages_covered": _avg("fraction_cropped_evidence_box_pages_covered"),
    "mean_max_crop_pair_iou": _avg("max_crop_pair_iou"), "rows_with_redundant_pair_rate": _avg("redundant_crop_pairs > 0"), "mean_redundant_pairs": _avg("redundant_crop_pairs"),
    **{
        f"{name}": sql
        for hit, among in (("any_evidence_page_hit", _PAGE), ("all_evidence_pages_hit", _PAGE), ("evidence_region_coverage_hit", _BOXED))
        for name, sql in (
            (f"rows_with_{hit}", _n(f"first_{hit}_step IS NOT NULL AND {among}")), (f"stopped_at_first_{hit}_fraction", _avg(f"stopped_at_first_{hit}", among)),
            (f"mean_extra_crops_after_first_{hit}", _avg(f"extra_crops_after_first_{hit}", among)),
        )
    },
}
_TRAINING_SQL = {
    "answerable_rows": _n("NOT is_unanswerable"), "unanswerable_rows_excluded_from_evidence_metrics": _n("is_unanswerable"), "answerable_rows_with_evidence": _n("NOT is_unanswerable AND has_evidence"),
    "answerable_rows_without_evidence": _n("NOT is_unanswerable AND NOT has_evidence"), "answerable_rows_with_evidence_fraction": f"round(CAST({_n('NOT is_unanswerable AND has_evidence')} AS DOUBLE) / greatest(1, {_n('NOT is_unanswerable')}), 6)",
    "answerable_rows_without_evidence_fraction": f"round(CAST({_n('NOT is_unanswerable AND NOT has_evidence')} AS DOUBLE) / greatest(1, {_n('NOT is_unanswerable')}), 6)",
    "crops_on_evidence_box_pages": _total("num_crops_on_evidence_box_pages"), "crop_evidence_region_hit_rate": _per(_total(_HIT), _total("num_crops")), "total_crops_per_evidence_region_hit_crop": _per(_total("num_crops"), _total(_HIT)),
}
_EXPORT_SQL = {
    "rows_with_final_output_match": _n("has_final_output_match"), "accuracy_reward_mean": _avg("accuracy_reward"), "compute_score_success_rate": _avg("compute_score_success"),
    **{f"crops_{i}": _n(f"num_crops = {i}") for i in range(5)}, "crops_5_plus": _n("num_crops >= 5"), "mean_tool_call_messages": _avg("tool_calls"), "mean_valid_tool_calls": _avg("n_valid_tool_calls"),
    "mean_core_inference_time": _avg("core_inference_time"), "median_core_inference_time": _pct("core_inference_time", 0.5), "p90_core_inference_time": _pct("core_inference_time", 0.9),
    "mean_conversation_wall_time": _avg("conversation_wall_time"), "mean_prompt_tokens": _avg("prompt_tokens"), "mean_response_tokens_generated": _avg("response_tokens_generated"),
    "mean_response_tokens_tool": _avg("response_tokens_tool"), "mean_response_tokens_total": _avg("response_tokens_total"), "mean_total_tokens": _avg("prompt_tokens + response_tokens_total"),
}


def _select(metrics: dict[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in metrics.items())


@REGISTRY.add("training_audit", sql=f"WITH {_ROWS} SELECT difficulty, subset, source, CAST(grouping(difficulty, subset, source) AS BIGINT) AS level, {_select({**_SHARED_SQL, **_TRAINING_SQL})} FROM measured GROUP BY GROUPING SETS ((), (difficulty), (subset), (source))")
def training_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of training conversations, overall, by difficulty, by subset and by source."""
    return plain(trajectory.training_summary(_measured(spark, sf_dir)))


@REGISTRY.add(
    "export_audit",
    sql=f"WITH {_ROWS}, named AS (SELECT *, difficulty AS rescale, subset AS benchmark FROM measured) SELECT rescale, benchmark, CAST(grouping(rescale, benchmark) AS BIGINT) AS level, {_select({**_SHARED_SQL, **_EXPORT_SQL})} FROM named GROUP BY ROLLUP (rescale, benchmark)",
)
def export_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of exported conversations, rolled up over rescale and benchmark."""
    rows = _measured(spark, sf_dir).withColumnsRenamed({"difficulty": "rescale", "subset": "benchmark"})
    return plain(trajectory.export_summary(rows))


@REGISTRY.add(
    "evidence_match",
    sql=f"WITH {_ROWS} SELECT conv, round(max_crop_evidence_iou, 6) AS max_iou, round(max_evidence_coverage, 6) AS max_coverage, round(max_crop_precision_vs_evidence, 6) AS max_precision, crop_hits_evidence_page AS page_hit, CAST({_HIT} AS BIGINT) AS covering_crops FROM measured WHERE has_evidence",
)
def evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best match of crops with evidence boxes on their page."""
    rows = _measured(spark, sf_dir).where("has_evidence")
    return plain(rows.select("conv", F.col("max_crop_evidence_iou").alias("max_iou"), F.col("max_evidence_coverage").alias("max_coverage"), F.col("max_crop_precision_vs_evidence").alias("max_precision"), F.col("crop_hits_evidence_page").alias("page_hit"), F.col(_HIT).alias("covering_crops")))


@REGISTRY.add("zoom_union_area", sql=f"WITH {_ROWS} SELECT conv, CAST(num_zoomed_source_pages AS BIGINT) AS pages, round(zoom_area_fraction_union, 6) AS union_share, round(zoom_area_fraction_sum, 6) AS sum_share FROM measured")
def zoom_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the zoomed pages that a conversation's crops cover, overlaps counted once and counted each."""
    return plain(_measured(spark, sf_dir).select("conv", F.col("num_zoomed_source_pages").alias("pages"), F.col("zoom_area_fraction_union").alias("union_share"), F.col("zoom_area_fraction_sum").alias("sum_share")))
