"""Monthly trajectory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trajectory as ops
from . import testbed as tb
from .registry import query, rounded

STOP = ", ".join(f"'{w}'" for w in ops.STOPWORDS)

POINTS = tb.with_tables("camp", "hist") + f""",
known AS (SELECT * FROM hist WHERE cost_per_lead IS NOT NULL),
keyed AS (SELECT *, days_elapsed + io_cycle * 30 AS age, coalesce(list_filter(string_split_regex(translate(campaign_name, '|-', '  '), '\\s+'),
    lambda w: length(w) > 2 AND lower(w) NOT IN ({STOP}))[1], '') AS keyword FROM camp),
own AS (SELECT campaign_id AS hid, report_month, cost_per_lead, row_number() OVER (PARTITION BY campaign_id ORDER BY report_month DESC) AS pos FROM known),
lost AS (SELECT DISTINCT partner_name, keyword FROM keyed WHERE CAST(campaign_id AS BIGINT) NOT IN (SELECT campaign_id FROM known)),
borrowed AS (SELECT partner_name, keyword, report_month, cost_per_lead,
    row_number() OVER (PARTITION BY partner_name, keyword ORDER BY report_month DESC, campaign_id) AS pos
  FROM lost JOIN known ON business_name = partner_name AND (keyword = '' OR campaign_name ILIKE '%' || keyword || '%')),
pts AS (SELECT c.campaign_id, o.report_month, o.cost_per_lead, o.pos FROM keyed c JOIN own o ON CAST(c.campaign_id AS BIGINT) = o.hid WHERE o.pos <= 12
  UNION ALL SELECT c.campaign_id, b.report_month, b.cost_per_lead, b.pos FROM keyed c JOIN borrowed b USING (partner_name, keyword)
    WHERE b.pos <= 12 AND CAST(c.campaign_id AS BIGINT) NOT IN (SELECT campaign_id FROM known)),
priced AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY campaign_id) AS n
  FROM pts WHERE cost_per_lead <> 0),
spark0 AS (SELECT *, min(cost_per_lead) OVER (PARTITION BY campaign_id) AS lo, max(cost_per_lead) OVER (PARTITION BY campaign_id) AS hi
  FROM priced WHERE i > n - 7),
agg AS (SELECT campaign_id, max(n) AS n,
    avg(cost_per_lead) FILTER (i <= least(3, n // 2)) AS recent, avg(cost_per_lead) FILTER (i > least(3, n // 2)) AS older,
    avg(cost_per_lead) FILTER (date_diff('day', report_month, DATE '2001-08-01') <= 45) AS last_30d_avg,
    avg(cost_per_lead) FILTER (date_diff('day', report_month, DATE '2001-08-01') <= 105) AS last_90d_avg,
    avg(cost_per_lead) FILTER (year(report_month) = 2001) AS ytd_avg FROM priced GROUP BY 1),
totals AS (SELECT campaign_id, count(*) AS np, arg_max(report_month, pos) AS oldest FROM pts GROUP BY 1),
traj AS (SELECT k.campaign_id, k.age, coalesce(np, 0) AS np, coalesce(a.n, 0) AS nv, (recent - older) / nullif(older, 0) * 100 AS change,
    last_30d_avg, last_90d_avg, ytd_avg, oldest FROM keyed k LEFT JOIN totals USING (campaign_id) LEFT JOIN agg a USING (campaign_id))"""


def rows(spark, sf):
    base = tb.campaigns(spark, sf).withColumn("days_elapsed", F.col("days_elapsed") + F.col("io_cycle") * 30)
    return base, tb.monthly_history(spark, sf)


def trajectories(spark, sf):
    base, history = rows(spark, sf)
    return ops.trajectories(base, history, tb.AS_OF)


@query("campaign_keywords", f"""{POINTS} SELECT campaign_id, keyword FROM keyed""")
def _(spark, sf):
    return tb.campaigns(spark, sf).select("campaign_id", ops.first_keyword("campaign_name").alias("keyword"))


@query("trajectory_points", f"""{POINTS} SELECT campaign_id, CAST(pos - 1 AS INTEGER) AS pos, report_month, cost_per_lead FROM pts""")
def _(spark, sf):
    base, history = rows(spark, sf)
    return ops.history_points(base, history).select("campaign_id", F.posexplode("points").alias("pos", "p")).select(
        "campaign_id", "pos", F.col("p.month").alias("report_month"), F.col("p.cpl").alias("cost_per_lead"))


@query("trajectories", f"""{POINTS} SELECT campaign_id, CASE WHEN np = 0 THEN 'none' WHEN np < 3 OR age < 60 THEN 'limited' WHEN np < 6 THEN 'moderate' ELSE 'rich' END AS data_quality,
CASE WHEN nv < 2 THEN 'insufficient_data' WHEN change > 10 THEN 'declining' WHEN change < -10 THEN 'improving' ELSE 'stable' END AS direction,
CASE WHEN nv >= 2 THEN round(abs(change), 8) END AS percentage, CASE WHEN nv >= 2 THEN CAST(nv * 30 AS INTEGER) END AS period_days,
CASE WHEN nv > 6 THEN 'high' WHEN nv > 3 THEN 'medium' ELSE 'low' END AS confidence, round(last_30d_avg, 8) AS last_30d_avg, round(last_90d_avg, 8) AS last_90d_avg,
round(ytd_avg, 8) AS ytd_avg, CAST(CASE WHEN nv = 0 THEN 0 ELSE np END AS INTEGER) AS data_points,
CASE WHEN nv > 0 THEN strftime(oldest, '%Y-%m') END AS earliest_data FROM traj""")
def _(spark, sf):
    t = trajectories(spark, sf)
    return rounded(t.select(
        "campaign_id", "data_quality", "trend.direction", "trend.percentage", "trend.period_days", "trend.confidence",
        "metrics.last_30d_avg", "metrics.last_90d_avg", "metrics.ytd_avg", "data_points", "earliest_data"), 8)


@query("sparklines", f"""{POINTS} SELECT campaign_id, CAST(row_number() OVER (PARTITION BY campaign_id ORDER BY i) - 1 AS INTEGER) AS pos,
CAST(CASE WHEN lo = hi THEN 50 ELSE round_even((cost_per_lead - lo) / (hi - lo) * 100, 0) END AS INTEGER) AS height FROM spark0 WHERE n >= 2""")
def _(spark, sf):
    return trajectories(spark, sf).select("campaign_id", F.posexplode("sparkline").alias("pos", "height"))


@query("sparkline_glyphs", f"""{POINTS}, level AS (SELECT campaign_id, i, least(CAST(floor(CASE WHEN lo = hi THEN 50 ELSE round_even((cost_per_lead - lo) / (hi - lo) * 100, 0) END / 12.5e0) AS INTEGER), 7) AS l
FROM spark0 WHERE n >= 2) SELECT campaign_id, string_agg(['▁', '▂', '▃', '▄', '▅', '▆', '▇', '█'][l + 1], '' ORDER BY i) AS glyphs FROM level GROUP BY 1""")
def _(spark, sf):
    return trajectories(spark, sf).where(F.size("sparkline") > 0).select(
        "campaign_id", ops.glyphs_of(F.col("sparkline")).alias("glyphs"))


@query("trajectory_with_terms", f"""{tb.with_tables("camp", "hist")} SELECT campaign_id, l.agreed AS agreed_cpl, l.mcid AS mcid_cpl, strftime(l.d, '%Y-%m-%d') AS cycle_start FROM camp
LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS campaign_id, max(l_extendedprice) AS agreed, min(l_extendedprice) AS mcid, min(l_shipdate) AS d FROM lineitem GROUP BY 1) l USING (campaign_id)""")
def _(spark, sf):
    agreed = tb.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("campaign_id")).agg(
        F.max("l_extendedprice").alias("cpl_agreed"), F.min("l_extendedprice").alias("cpl_mcid"),
        F.min("l_shipdate").alias("cycle_start_date"))
    base, history = rows(spark, sf)
    return ops.trajectories(base, history, tb.AS_OF, agreed).select("campaign_id", "agreed_cpl", "mcid_cpl", "cycle_start")
