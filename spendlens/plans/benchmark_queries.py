"""Benchmark lookups, diagnosis and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark as ops
from ..operators.percentiles import benchmark_percentiles
from . import testbed as tb
from .registry import query, rounded

DIAG = tb.with_tables("catbench", "req") + """,
med AS (SELECT * FROM catbench WHERE snapshot_id = (SELECT max(snapshot_id) FROM catbench)),
diag AS (SELECT r.*, category || '|' || subcategory AS category_key,
    nullif(round_even(budget / nullif(clicks, 0) * 100, 0) / 100, 0) AS cpc, nullif(round_even(budget / nullif(leads, 0) * 100, 0) / 100, 0) AS cpl,
    nullif(round_even(leads / nullif(clicks, 0) * 10000, 0) / 10000, 0) AS cr, nullif(round_even(clicks / nullif(impressions, 0) * 10000, 0) / 10000, 0) AS ctr,
    round_even(cpl_median * 100, 0) / 100 AS median_cpl, round_even(cpc_median * 100, 0) / 100 AS median_cpc,
    round_even(ctr_median * 10000, 0) / 10000 AS median_ctr, round_even(budget_median * 100, 0) / 100 AS median_budget,
    CASE WHEN goal_cpl IS NULL OR leads = 0 THEN 'unknown' WHEN budget / leads <= goal_cpl THEN 'achieved' ELSE 'behind' END AS goal_status
  FROM req r JOIN med USING (category, subcategory)),
range AS (SELECT *, median_cpc / median_cpl AS median_cr,
    greatest(median_cpl - median_cpl * 0.15e0, 0) AS cpl_lo, median_cpl + median_cpl * 0.15e0 AS cpl_hi,
    greatest(median_cpc - median_cpc * 0.15e0, 0) AS cpc_lo, median_cpc + median_cpc * 0.15e0 AS cpc_hi,
    greatest(median_cr - median_cr * 0.15e0, 0) AS cr_lo, median_cr + median_cr * 0.15e0 AS cr_hi FROM diag),
long AS (SELECT request_id, 'CPL' AS metric, cpl AS v, median_cpl AS m, cpl_lo AS lo, cpl_hi AS hi, 1 AS low_is_good FROM range
  UNION ALL SELECT request_id, 'CPC', cpc, median_cpc, cpc_lo, cpc_hi, 1 FROM range
  UNION ALL SELECT request_id, 'CR', cr, median_cr, cr_lo, cr_hi, 0 FROM range),
panel0 AS (SELECT *, CASE WHEN v IS NULL THEN 'unknown' WHEN v >= lo AND v <= hi THEN 'on_target'
      WHEN (low_is_good = 1) = (v < lo) THEN 'exceeds_target' ELSE 'outside_target' END AS verdict,
    CASE WHEN v < lo THEN (lo - v) / greatest(lo, 1e-9) * 100 WHEN v > hi THEN (v - hi) / greatest(hi, 1e-9) * 100 WHEN v IS NOT NULL THEN 0e0 END AS delta FROM long),
panel AS (SELECT *, CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN verdict IN ('on_target', 'exceeds_target') THEN 'GOOD' WHEN delta <= 15 THEN 'AVG' ELSE 'WEAK' END AS status FROM panel0)"""


def latest(spark, sf):
    return ops.latest_benchmarks(tb.category_benchmarks(spark, sf))


def diagnosed(spark, sf):
    return ops.diagnose(tb.diagnosis_requests(spark, sf), latest(spark, sf))


@query("benchmark_categories", f"""{tb.with_tables("catbench")} SELECT DISTINCT category || '|' || subcategory AS key, category, subcategory FROM catbench""")
def _(spark, sf):
    return ops.categories(tb.category_benchmarks(spark, sf))


@query("latest_benchmarks", f"""{tb.with_tables("catbench")} SELECT * FROM catbench WHERE snapshot_id = (SELECT max(snapshot_id) FROM catbench)""")
def _(spark, sf):
    return latest(spark, sf).select("category", "subcategory", "snapshot_id", "cpl_median", "cpc_median", "ctr_median", "budget_median", "sample_size")


@query("newest_benchmark_per_category", f"""{tb.with_tables("catbench")} SELECT category, subcategory, arg_max(cpl_median, snapshot_id) AS cpl_median,
max(snapshot_id) AS snapshot_id FROM catbench GROUP BY 1, 2""")
def _(spark, sf):
    return ops.newest_per_category(tb.category_benchmarks(spark, sf), "snapshot_id").select(
        "category", "subcategory", "cpl_median", "snapshot_id")


@query("benchmark_records", f"""{tb.with_tables("catbench")} SELECT category, subcategory, snapshot_id, cpl_median, cpl_median * 0.5e0 AS cpl_top10, ctr_median, budget_median FROM catbench""")
def _(spark, sf):
    rows = tb.category_benchmarks(spark, sf).withColumn("cpl_top10", F.col("cpl_median") * 0.5)
    rows = rows.withColumn("r", ops.benchmark_record(rows.columns))
    return rows.select("category", "subcategory", "snapshot_id", F.col("r.cpl.median").alias("cpl_median"),
                       F.col("r.cpl.dms.top10").alias("cpl_top10"), F.col("r.ctr.median").alias("ctr_median"),
                       F.col("r.budget.median").alias("budget_median"))


@query("diagnosis", f"""{DIAG} SELECT request_id, category_key, cpc, cpl, cr, ctr, median_cpl, median_cpc, median_ctr, median_budget, goal_status,
CASE goal_status WHEN 'achieved' THEN 'scale' WHEN 'behind' THEN 'optimize' END AS primary_recommendation FROM diag""")
def _(spark, sf):
    return diagnosed(spark, sf).select(
        "request_id", "category_key", "cpc", "cpl", "cr", "ctr", "median_cpl", "median_cpc", "median_ctr", "median_budget",
        "goal_status", "primary_recommendation")


@query("target_ranges", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size * 0.5e0 WHEN p_partkey % 4 = 1 THEN greatest(0, p_size - 20)
  ELSE greatest(0e0, m - greatest(0.00001e0, m * 0.15e0)) END::DOUBLE AS low,
CASE WHEN p_partkey % 4 = 0 THEN p_size WHEN p_partkey % 4 = 1 THEN greatest(p_size - 20, 25) ELSE m + greatest(0.00001e0, m * 0.15e0) END::DOUBLE AS high
FROM (SELECT *, CASE p_partkey % 4 WHEN 2 THEN p_retailprice ELSE 50e0 END AS m FROM part)""")
def _(spark, sf):
    """A given range, a known middle half, a median, and nothing known, in turn over all parts."""
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    low, high = ops.target_range(
        "CPL", F.when(kind == 2, F.col("p_retailprice")), None, F.when(kind != 2, F.when(kind == 1, size - 20)), F.when(kind == 1, F.lit(25.0)),
        F.when(kind == 0, size * 0.5), F.when(kind == 0, size))
    return tb.table(spark, sf, "part").select("p_partkey", low.alias("low"), high.alias("high"))


@query("diagnosis_history", f"""{DIAG} SELECT request_id, category_key, budget, clicks, leads, goal_cpl, cpl, cpc, cr, goal_status,
CASE goal_status WHEN 'achieved' THEN 'scale' WHEN 'behind' THEN 'optimize' END AS primary_recommendation, TIMESTAMP '2025-09-20 06:00:00' AS created_at FROM diag""")
def _(spark, sf):
    return ops.diagnosis_history(diagnosed(spark, sf), F.lit("2025-09-20 06:00:00").cast("timestamp_ntz"))


@query("metric_panel", f"""{DIAG} SELECT request_id, metric, v AS value, round(lo, 9) AS target_low, round(hi, 9) AS target_high, verdict, round(delta, 6) AS delta_pct, status FROM panel""")
def _(spark, sf):
    return ops.metric_panel(diagnosed(spark, sf)).select(
        "request_id", "metric", "value", F.round("target_low", 9).alias("target_low"), F.round("target_high", 9).alias("target_high"),
        "verdict", F.round("delta_pct", 6).alias("delta_pct"), "status")


@query("metric_bars", f"""{DIAG}, stops AS (SELECT CASE WHEN s < 0 THEN 'CR' ELSE 'money' END AS kind, abs(s) AS s FROM (SELECT unnest([
  0.5e0, 1, 2, 3, 5, 7.5e0, 10, 12, 15, 20, 25, 30, 40, 50, 60, 75, 100, 150, 200, 250, 300, 400, 500, 750, 1000,
  -0.05e0, -0.08e0, -0.1e0, -0.12e0, -0.15e0, -0.18e0, -0.2e0, -0.25e0, -0.3e0, -0.4e0, -0.5e0, -0.6e0, -0.8e0, -1e0]) AS s)),
top AS (SELECT *, CASE metric WHEN 'CPL' THEN greatest(greatest(coalesce(v, 0), hi, m) * 1.4e0, hi * 1.6e0, m * 1.5e0) ELSE greatest(coalesce(v, 0), hi, m) END * 1.15e0 AS want FROM panel),
axis AS (SELECT t.request_id, t.metric, any_value(v) AS v, any_value(lo) AS lo, any_value(hi) AS hi, any_value(low_is_good) AS g,
  coalesce(min(s), CASE WHEN t.metric = 'CR' THEN least(1e0, ceil(any_value(want) * 20) / 20) ELSE ceil(any_value(want) / 100) * 100 END) AS axis_end
  FROM top t LEFT JOIN stops ON s >= want AND kind = CASE WHEN metric = 'CR' THEN 'CR' ELSE 'money' END GROUP BY 1, 2)
SELECT request_id, metric, axis_end, round(greatest(least(v / axis_end, 1), 0) * 100, 9) AS position,
  CASE WHEN v < lo THEN CASE g WHEN 1 THEN 'excellent' ELSE 'needs-improvement' END WHEN v > hi THEN CASE g WHEN 1 THEN 'needs-improvement' ELSE 'excellent' END ELSE 'target-range' END AS section,
  round(least(lo / axis_end, 1) * 100, 9) AS low_width FROM axis""")
def _(spark, sf):
    return ops.metric_panel(diagnosed(spark, sf)).select(
        "request_id", "metric", "bar.axis_end", F.round("bar.position", 9).alias("position"), "bar.section",
        F.round("bar.low_width", 9).alias("low_width"))


@query("rule_diagnosis", f"""{DIAG}, st AS (SELECT request_id, bool_or(status = 'WEAK' AND metric = 'CPL') AS wl, bool_or(status = 'WEAK' AND metric = 'CPC') AS wc,
  bool_or(status = 'WEAK' AND metric = 'CR') AS wr FROM panel GROUP BY 1)
SELECT request_id, CASE WHEN clicks = 0 THEN 'no_traffic' WHEN (leads = 0 AND clicks >= 100) OR coalesce(cr > greatest(cr_hi * 1.8e0, 0.15e0), false) THEN 'verify_tracking'
  WHEN budget < 500 THEN 'budget_too_low' WHEN NOT (wl OR wc OR wr) AND goal_status = 'achieved' THEN 'ready_to_scale' WHEN NOT (wl OR wc OR wr) THEN 'realign_goal'
  WHEN goal_status <> 'behind' THEN 'monitor' WHEN wr AND NOT wc THEN 'fix_conversion_rate' WHEN wc AND NOT wr THEN 'reduce_traffic_cost'
  WHEN cpc > cpc_hi * 1.5e0 AND NOT cr < cr_lo * 0.5e0 THEN 'cpc_then_cr' ELSE 'cr_then_cpc' END AS diagnosis,
  leads < 15 OR clicks < 300 AS provisional, budget < 1000 AS budget_constrained, round(cpc / goal_cpl, 9) AS needed_cr, round(goal_cpl * cr, 9) AS needed_cpc
FROM range JOIN st USING (request_id)""")
def _(spark, sf):
    return ops.rule_diagnosis(diagnosed(spark, sf)).select(
        "request_id", "diagnosis", "provisional", "budget_constrained", F.round("needed_cr", 9).alias("needed_cr"),
        F.round("needed_cpc", 9).alias("needed_cpc"))


@query("goal_check", f"""{DIAG} SELECT request_id, goal_cpl, round(cpl_lo, 9) AS typical_low, round(cpl_hi, 9) AS typical_high,
CASE WHEN goal_cpl < cpl_lo THEN 'below' WHEN goal_cpl > cpl_hi THEN 'above' ELSE 'within' END AS position,
CAST(floor(CASE WHEN goal_cpl < cpl_lo THEN (cpl_lo - goal_cpl) / cpl_lo * 100 WHEN goal_cpl > cpl_hi THEN (goal_cpl - cpl_hi) / cpl_hi * 100 ELSE 0 END + 0.5e0) AS BIGINT) AS off_pct
FROM range WHERE goal_cpl IS NOT NULL""")
def _(spark, sf):
    return rounded(ops.goal_check(diagnosed(spark, sf)), 9)


GRID = (("base", 1.0, 1.0, 1.0), ("half_budget", 0.5, 1.0, 1.0), ("more_budget", 3.0, 1.0, 1.0), ("cheap_clicks", 1.0, 0.4, 1.0), ("better_pages", 1.0, 1.0, 2.5))


@query("scenarios", f"""{DIAG}, base AS (SELECT request_id, goal_cpl, budget AS b, coalesce(cpc, median_cpc) AS c, coalesce(cr, median_cr) AS r FROM range),
lim AS (SELECT *, greatest(b * 2, 1e4) AS bmax, greatest(0.2e0, c * 0.5e0) AS cmin, c * 1.8e0 AS cmax0, greatest(0.001e0, r * 0.3e0) AS rmin, least(1e0, r * 2) AS rmax FROM base),
lim2 AS (SELECT *, CASE WHEN cmin >= cmax0 THEN c * 2 ELSE cmax0 END AS cmax FROM lim),
grid AS (SELECT * FROM (VALUES ('base', 1e0, 1e0, 1e0), ('half_budget', 0.5e0, 1e0, 1e0), ('more_budget', 3e0, 1e0, 1e0), ('cheap_clicks', 1e0, 0.4e0, 1e0), ('better_pages', 1e0, 1e0, 2.5e0)) g(scenario, fb, fc, fr)),
opt AS (SELECT request_id, scenario, least(b * fb, bmax) AS budget, least(greatest(c * fc, cmin), cmax) AS cpc, least(greatest(r * fr, rmin), rmax) AS cr FROM lim2, grid
  UNION ALL SELECT request_id, 'snap_cr', b, c, least(greatest(c / goal_cpl, rmin), rmax) FROM lim2 WHERE goal_cpl > 0
  UNION ALL SELECT request_id, 'snap_cpc', b, least(greatest(goal_cpl * r, cmin), cmax), r FROM lim2 WHERE goal_cpl > 0)
SELECT request_id, scenario, budget, cpc, cr, budget / cpc AS clicks, budget * cr / cpc AS leads, cpc / cr AS cpl,
  budget / cpc < 300 OR budget * cr / cpc < 15 AS low_volume, budget >= 500 AND budget < 1000 AS budget_constrained FROM opt""")
def _(spark, sf):
    return ops.scenarios(diagnosed(spark, sf), GRID)


@query("benchmark_percentiles", f"""{tb.with_tables("req")},
v AS (SELECT category, subcategory, CASE WHEN leads > 0 THEN budget / leads END AS cpl,
    CASE WHEN clicks > 0 THEN budget / clicks END AS cpc, CASE WHEN impressions > 0 THEN clicks / impressions END AS ctr,
    round(budget * 100) AS budget FROM req),
g AS (SELECT category, subcategory, count(*) AS n, list_sort(list(cpl) FILTER (cpl IS NOT NULL)) AS s_cpl, avg(cpl) AS a_cpl, list_sort(list(cpc) FILTER (cpc IS NOT NULL)) AS s_cpc, avg(cpc) AS a_cpc, list_sort(list(ctr) FILTER (ctr IS NOT NULL)) AS s_ctr, avg(ctr) AS a_ctr, list_sort(list(budget) FILTER (budget IS NOT NULL)) AS s_budget, avg(budget) AS a_budget FROM v GROUP BY ALL)
SELECT category, subcategory,
  round_even((CASE WHEN len(s_cpl) = 0 THEN NULL WHEN floor((len(s_cpl) - 1) * 0.5::DOUBLE) = ceil((len(s_cpl) - 1) * 0.5::DOUBLE) THEN s_cpl[floor((len(s_cpl) - 1) * 0.5::DOUBLE)::BIGINT + 1] ELSE s_cpl[floor((len(s_cpl) - 1) * 0.5::DOUBLE)::BIGINT + 1] + (s_cpl[ceil((len(s_cpl) - 1) * 0.5::DOUBLE)::BIGINT + 1] - s_cpl[floor((len(s_cpl) - 1) * 0.5::DOUBLE)::BIGINT + 1]) * ((len(s_cpl) - 1) * 0.5::DOUBLE - floor((len(s_cpl) - 1) * 0.5::DOUBLE)) END) * 100, 0) / 100 AS cpl_median,
  round_even((CASE WHEN len(s_cpl) = 0 THEN NULL WHEN floor((len(s_cpl) - 1) * 0.1::DOUBLE) = ceil((len(s_cpl) - 1) * 0.1::DOUBLE) THEN s_cpl[floor((len(s_cpl) - 1) * 0.1::DOUBLE)::BIGINT + 1] ELSE s_cpl[floor((len(s_cpl) - 1) * 0.1::DOUBLE)::BIGINT + 1] + (s_cpl[ceil((len(s_cpl) - 1) * 0.1::DOUBLE)::BIGINT + 1] - s_cpl[floor((len(s_cpl) - 1) * 0.1::DOUBLE)::BIGINT + 1]) * ((len(s_cpl) - 1) * 0.1::DOUBLE - floor((len(s_cpl) - 1) * 0.1::DOUBLE)) END) * 100, 0) / 100 AS cpl_top10,
  round_even((CASE WHEN len(s_cpl) = 0 THEN NULL WHEN floor((len(s_cpl) - 1) * 0.25::DOUBLE) = ceil((len(s_cpl) - 1) * 0.25::DOUBLE) THEN s_cpl[floor((len(s_cpl) - 1) * 0.25::DOUBLE)::BIGINT + 1] ELSE s_cpl[floor((len(s_cpl) - 1) * 0.25::DOUBLE)::BIGINT + 1] + (s_cpl[ceil((len(s_cpl) - 1) * 0.25::DOUBLE)::BIGINT + 1] - s_cpl[floor((len(s_cpl) - 1) * 0.25::DOUBLE)::BIGINT + 1]) * ((len(s_cpl) - 1) * 0.25::DOUBLE - floor((len(s_cpl) - 1) * 0.25::DOUBLE)) END) * 100, 0) / 100 AS cpl_top25,
  round_even(a_cpl * 100, 0) / 100 AS cpl_avg,
  round_even((CASE WHEN len(s_cpl) = 0 THEN NULL WHEN floor((len(s_cpl) - 1) * 0.75::DOUBLE) = ceil((len(s_cpl) - 1) * 0.75::DOUBLE) THEN s_cpl[floor((len(s_cpl) - 1) * 0.75::DOUBLE)::BIGINT + 1] ELSE s_cpl[floor((len(s_cpl) - 1) * 0.75::DOUBLE)::BIGINT + 1] + (s_cpl[ceil((len(s_cpl) - 1) * 0.75::DOUBLE)::BIGINT + 1] - s_cpl[floor((len(s_cpl) - 1) * 0.75::DOUBLE)::BIGINT + 1]) * ((len(s_cpl) - 1) * 0.75::DOUBLE - floor((len(s_cpl) - 1) * 0.75::DOUBLE)) END) * 100, 0) / 100 AS cpl_bot25,
  round_even((CASE WHEN len(s_cpl) = 0 THEN NULL WHEN floor((len(s_cpl) - 1) * 0.9::DOUBLE) = ceil((len(s_cpl) - 1) * 0.9::DOUBLE) THEN s_cpl[floor((len(s_cpl) - 1) * 0.9::DOUBLE)::BIGINT + 1] ELSE s_cpl[floor((len(s_cpl) - 1) * 0.9::DOUBLE)::BIGINT + 1] + (s_cpl[ceil((len(s_cpl) - 1) * 0.9::DOUBLE)::BIGINT + 1] - s_cpl[floor((len(s_cpl) - 1) * 0.9::DOUBLE)::BIGINT + 1]) * ((len(s_cpl) - 1) * 0.9::DOUBLE - floor((len(s_cpl) - 1) * 0.9::DOUBLE)) END) * 100, 0) / 100 AS cpl_bot10,
  round_even((CASE WHEN len(s_cpc) = 0 THEN NULL WHEN floor((len(s_cpc) - 1) * 0.5::DOUBLE) = ceil((len(s_cpc) - 1) * 0.5::DOUBLE) THEN s_cpc[floor((len(s_cpc) - 1) * 0.5::DOUBLE)::BIGINT + 1] ELSE s_cpc[floor((len(s_cpc) - 1) * 0.5::DOUBLE)::BIGINT + 1] + (s_cpc[ceil((len(s_cpc) - 1) * 0.5::DOUBLE)::BIGINT + 1] - s_cpc[floor((len(s_cpc) - 1) * 0.5::DOUBLE)::BIGINT + 1]) * ((len(s_cpc) - 1) * 0.5::DOUBLE - floor((len(s_cpc) - 1) * 0.5::DOUBLE)) END) * 100, 0) / 100 AS cpc_median,
  round_even((CASE WHEN len(s_cpc) = 0 THEN NULL WHEN floor((len(s_cpc) - 1) * 0.1::DOUBLE) = ceil((len(s_cpc) - 1) * 0.1::DOUBLE) THEN s_cpc[floor((len(s_cpc) - 1) * 0.1::DOUBLE)::BIGINT + 1] ELSE s_cpc[floor((len(s_cpc) - 1) * 0.1::DOUBLE)::BIGINT + 1] + (s_cpc[ceil((len(s_cpc) - 1) * 0.1::DOUBLE)::BIGINT + 1] - s_cpc[floor((len(s_cpc) - 1) * 0.1::DOUBLE)::BIGINT + 1]) * ((len(s_cpc) - 1) * 0.1::DOUBLE - floor((len(s_cpc) - 1) * 0.1::DOUBLE)) END) * 100, 0) / 100 AS cpc_top10,
  round_even((CASE WHEN len(s_cpc) = 0 THEN NULL WHEN floor((len(s_cpc) - 1) * 0.25::DOUBLE) = ceil((len(s_cpc) - 1) * 0.25::DOUBLE) THEN s_cpc[floor((len(s_cpc) - 1) * 0.25::DOUBLE)::BIGINT + 1] ELSE s_cpc[floor((len(s_cpc) - 1) * 0.25::DOUBLE)::BIGINT + 1] + (s_cpc[ceil((len(s_cpc) - 1) * 0.25::DOUBLE)::BIGINT + 1] - s_cpc[floor((len(s_cpc) - 1) * 0.25::DOUBLE)::BIGINT + 1]) * ((len(s_cpc) - 1) * 0.25::DOUBLE - floor((len(s_cpc) - 1) * 0.25::DOUBLE)) END) * 100, 0) / 100 AS cpc_top25,
  round_even(a_cpc * 100, 0) / 100 AS cpc_avg,
  round_even((CASE WHEN len(s_cpc) = 0 THEN NULL WHEN floor((len(s_cpc) - 1) * 0.75::DOUBLE) = ceil((len(s_cpc) - 1) * 0.75::DOUBLE) THEN s_cpc[floor((len(s_cpc) - 1) * 0.75::DOUBLE)::BIGINT + 1] ELSE s_cpc[floor((len(s_cpc) - 1) * 0.75::DOUBLE)::BIGINT + 1] + (s_cpc[ceil((len(s_cpc) - 1) * 0.75::DOUBLE)::BIGINT + 1] - s_cpc[floor((len(s_cpc) - 1) * 0.75::DOUBLE)::BIGINT + 1]) * ((len(s_cpc) - 1) * 0.75::DOUBLE - floor((len(s_cpc) - 1) * 0.75::DOUBLE)) END) * 100, 0) / 100 AS cpc_bot25,
  round_even((CASE WHEN len(s_cpc) = 0 THEN NULL WHEN floor((len(s_cpc) - 1) * 0.9::DOUBLE) = ceil((len(s_cpc) - 1) * 0.9::DOUBLE) THEN s_cpc[floor((len(s_cpc) - 1) * 0.9::DOUBLE)::BIGINT + 1] ELSE s_cpc[floor((len(s_cpc) - 1) * 0.9::DOUBLE)::BIGINT + 1] + (s_cpc[ceil((len(s_cpc) - 1) * 0.9::DOUBLE)::BIGINT + 1] - s_cpc[floor((len(s_cpc) - 1) * 0.9::DOUBLE)::BIGINT + 1]) * ((len(s_cpc) - 1) * 0.9::DOUBLE - floor((len(s_cpc) - 1) * 0.9::DOUBLE)) END) * 100, 0) / 100 AS cpc_bot10,
  round_even((CASE WHEN len(s_ctr) = 0 THEN NULL WHEN floor((len(s_ctr) - 1) * 0.5::DOUBLE) = ceil((len(s_ctr) - 1) * 0.5::DOUBLE) THEN s_ctr[floor((len(s_ctr) - 1) * 0.5::DOUBLE)::BIGINT + 1] ELSE s_ctr[floor((len(s_ctr) - 1) * 0.5::DOUBLE)::BIGINT + 1] + (s_ctr[ceil((len(s_ctr) - 1) * 0.5::DOUBLE)::BIGINT + 1] - s_ctr[floor((len(s_ctr) - 1) * 0.5::DOUBLE)::BIGINT + 1]) * ((len(s_ctr) - 1) * 0.5::DOUBLE - floor((len(s_ctr) - 1) * 0.5::DOUBLE)) END) * 1000000, 0) / 1000000 AS ctr_median,
  round_even((CASE WHEN len(s_ctr) = 0 THEN NULL WHEN floor((len(s_ctr) - 1) * 0.9::DOUBLE) = ceil((len(s_ctr) - 1) * 0.9::DOUBLE) THEN s_ctr[floor((len(s_ctr) - 1) * 0.9::DOUBLE)::BIGINT + 1] ELSE s_ctr[floor((len(s_ctr) - 1) * 0.9::DOUBLE)::BIGINT + 1] + (s_ctr[ceil((len(s_ctr) - 1) * 0.9::DOUBLE)::BIGINT + 1] - s_ctr[floor((len(s_ctr) - 1) * 0.9::DOUBLE)::BIGINT + 1]) * ((len(s_ctr) - 1) * 0.9::DOUBLE - floor((len(s_ctr) - 1) * 0.9::DOUBLE)) END) * 1000000, 0) / 1000000 AS ctr_top10,
  round_even((CASE WHEN len(s_ctr) = 0 THEN NULL WHEN floor((len(s_ctr) - 1) * 0.75::DOUBLE) = ceil((len(s_ctr) - 1) * 0.75::DOUBLE) THEN s_ctr[floor((len(s_ctr) - 1) * 0.75::DOUBLE)::BIGINT + 1] ELSE s_ctr[floor((len(s_ctr) - 1) * 0.75::DOUBLE)::BIGINT + 1] + (s_ctr[ceil((len(s_ctr) - 1) * 0.75::DOUBLE)::BIGINT + 1] - s_ctr[floor((len(s_ctr) - 1) * 0.75::DOUBLE)::BIGINT + 1]) * ((len(s_ctr) - 1) * 0.75::DOUBLE - floor((len(s_ctr) - 1) * 0.75::DOUBLE)) END) * 1000000, 0) / 1000000 AS ctr_top25,
  round_even(a_ctr * 1000000, 0) / 1000000 AS ctr_avg,
  round_even((CASE WHEN len(s_ctr) = 0 THEN NULL WHEN floor((len(s_ctr) - 1) * 0.25::DOUBLE) = ceil((len(s_ctr) - 1) * 0.25::DOUBLE) THEN s_ctr[floor((len(s_ctr) - 1) * 0.25::DOUBLE)::BIGINT + 1] ELSE s_ctr[floor((len(s_ctr) - 1) * 0.25::DOUBLE)::BIGINT + 1] + (s_ctr[ceil((len(s_ctr) - 1) * 0.25::DOUBLE)::BIGINT + 1] - s_ctr[floor((len(s_ctr) - 1) * 0.25::DOUBLE)::BIGINT + 1]) * ((len(s_ctr) - 1) * 0.25::DOUBLE - floor((len(s_ctr) - 1) * 0.25::DOUBLE)) END) * 1000000, 0) / 1000000 AS ctr_bot25,
  round_even((CASE WHEN len(s_ctr) = 0 THEN NULL WHEN floor((len(s_ctr) - 1) * 0.1::DOUBLE) = ceil((len(s_ctr) - 1) * 0.1::DOUBLE) THEN s_ctr[floor((len(s_ctr) - 1) * 0.1::DOUBLE)::BIGINT + 1] ELSE s_ctr[floor((len(s_ctr) - 1) * 0.1::DOUBLE)::BIGINT + 1] + (s_ctr[ceil((len(s_ctr) - 1) * 0.1::DOUBLE)::BIGINT + 1] - s_ctr[floor((len(s_ctr) - 1) * 0.1::DOUBLE)::BIGINT + 1]) * ((len(s_ctr) - 1) * 0.1::DOUBLE - floor((len(s_ctr) - 1) * 0.1::DOUBLE)) END) * 1000000, 0) / 1000000 AS ctr_bot10,
  round_even((CASE WHEN len(s_budget) = 0 THEN NULL WHEN floor((len(s_budget) - 1) * 0.5::DOUBLE) = ceil((len(s_budget) - 1) * 0.5::DOUBLE) THEN s_budget[floor((len(s_budget) - 1) * 0.5::DOUBLE)::BIGINT + 1] ELSE s_budget[floor((len(s_budget) - 1) * 0.5::DOUBLE)::BIGINT + 1] + (s_budget[ceil((len(s_budget) - 1) * 0.5::DOUBLE)::BIGINT + 1] - s_budget[floor((len(s_budget) - 1) * 0.5::DOUBLE)::BIGINT + 1]) * ((len(s_budget) - 1) * 0.5::DOUBLE - floor((len(s_budget) - 1) * 0.5::DOUBLE)) END), 0) / 100 AS budget_median,
  round_even((CASE WHEN len(s_budget) = 0 THEN NULL WHEN floor((len(s_budget) - 1) * 0.1::DOUBLE) = ceil((len(s_budget) - 1) * 0.1::DOUBLE) THEN s_budget[floor((len(s_budget) - 1) * 0.1::DOUBLE)::BIGINT + 1] ELSE s_budget[floor((len(s_budget) - 1) * 0.1::DOUBLE)::BIGINT + 1] + (s_budget[ceil((len(s_budget) - 1) * 0.1::DOUBLE)::BIGINT + 1] - s_budget[floor((len(s_budget) - 1) * 0.1::DOUBLE)::BIGINT + 1]) * ((len(s_budget) - 1) * 0.1::DOUBLE - floor((len(s_budget) - 1) * 0.1::DOUBLE)) END), 0) / 100 AS budget_p10_bottom,
  round_even((CASE WHEN len(s_budget) = 0 THEN NULL WHEN floor((len(s_budget) - 1) * 0.25::DOUBLE) = ceil((len(s_budget) - 1) * 0.25::DOUBLE) THEN s_budget[floor((len(s_budget) - 1) * 0.25::DOUBLE)::BIGINT + 1] ELSE s_budget[floor((len(s_budget) - 1) * 0.25::DOUBLE)::BIGINT + 1] + (s_budget[ceil((len(s_budget) - 1) * 0.25::DOUBLE)::BIGINT + 1] - s_budget[floor((len(s_budget) - 1) * 0.25::DOUBLE)::BIGINT + 1]) * ((len(s_budget) - 1) * 0.25::DOUBLE - floor((len(s_budget) - 1) * 0.25::DOUBLE)) END), 0) / 100 AS budget_p25_bottom,
  round_even(a_budget, 0) / 100 AS budget_avg,
  round_even((CASE WHEN len(s_budget) = 0 THEN NULL WHEN floor((len(s_budget) - 1) * 0.75::DOUBLE) = ceil((len(s_budget) - 1) * 0.75::DOUBLE) THEN s_budget[floor((len(s_budget) - 1) * 0.75::DOUBLE)::BIGINT + 1] ELSE s_budget[floor((len(s_budget) - 1) * 0.75::DOUBLE)::BIGINT + 1] + (s_budget[ceil((len(s_budget) - 1) * 0.75::DOUBLE)::BIGINT + 1] - s_budget[floor((len(s_budget) - 1) * 0.75::DOUBLE)::BIGINT + 1]) * ((len(s_budget) - 1) * 0.75::DOUBLE - floor((len(s_budget) - 1) * 0.75::DOUBLE)) END), 0) / 100 AS budget_p25_top,
  round_even((CASE WHEN len(s_budget) = 0 THEN NULL WHEN floor((len(s_budget) - 1) * 0.9::DOUBLE) = ceil((len(s_budget) - 1) * 0.9::DOUBLE) THEN s_budget[floor((len(s_budget) - 1) * 0.9::DOUBLE)::BIGINT + 1] ELSE s_budget[floor((len(s_budget) - 1) * 0.9::DOUBLE)::BIGINT + 1] + (s_budget[ceil((len(s_budget) - 1) * 0.9::DOUBLE)::BIGINT + 1] - s_budget[floor((len(s_budget) - 1) * 0.9::DOUBLE)::BIGINT + 1]) * ((len(s_budget) - 1) * 0.9::DOUBLE - floor((len(s_budget) - 1) * 0.9::DOUBLE)) END), 0) / 100 AS budget_p10_top,
  n::INTEGER AS sample_size, true AS exact
FROM g""")
def _(spark, sf):
    return benchmark_percentiles(tb.diagnosis_requests(spark, sf))
