"""Performance views, dashboards, trends and reports over the derived campaign tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import incremental
from ..operators import performance as ops
from ..operators import reports
from . import testbed as tb
from ..shared import shared_folder
from .registry import query, rounded

PERF = tb.with_tables("camp", "brand") + """,
newest AS (SELECT * FROM brand WHERE snapshot_date = (SELECT max(snapshot_date) FROM brand)),
perf_of AS (SELECT c.*, b.cpl_median, b.cpc_median, b.cpl_top25, b.cpl_bot25 FROM camp c
  LEFT JOIN newest b ON lower(c.product) = b.key WHERE c.running_cid_leads > 0),
perf AS (SELECT campaign_id, campaign_name, advertiser_name, channel, product, amount_spent AS actual_spend,
    campaign_budget AS budget, running_cid_leads AS leads, clicks, running_cid_cpl AS actual_cpl,
    avg_cpc AS actual_cpc, CASE WHEN clicks > 0 THEN running_cid_leads / clicks END AS conversion_rate,
    cpl_median AS benchmark_cpl_median, cpc_median AS benchmark_cpc_median,
    CASE WHEN running_cid_cpl <= cpl_top25 THEN 'excellent' WHEN running_cid_cpl <= cpl_median THEN 'good'
         WHEN running_cid_cpl <= cpl_bot25 THEN 'average' ELSE 'below_average' END AS cpl_performance_tier,
    snapshot_date, extracted_at FROM perf_of)"""

PERF_COLUMNS = """campaign_id, campaign_name, advertiser_name, channel, product, actual_spend, budget, leads, clicks,
  actual_cpl, actual_cpc, conversion_rate, benchmark_cpl_median, benchmark_cpc_median, cpl_performance_tier,
  snapshot_date, extracted_at"""

DASH = """dash AS (SELECT CAST(date_trunc('month', snapshot_date) AS DATE) AS month,
    count(DISTINCT campaign_name) AS total_campaigns, round(sum(actual_spend), 4) AS total_spend,
    CAST(sum(leads) AS BIGINT) AS total_leads, CAST(sum(clicks) AS BIGINT) AS total_clicks,
    round(avg(actual_cpl), 4) AS avg_cpl, round(avg(actual_cpc), 4) AS avg_cpc,
    count(*) FILTER (cpl_performance_tier = 'excellent') AS excellent_campaigns,
    count(*) FILTER (cpl_performance_tier = 'good') AS good_campaigns,
    count(*) FILTER (cpl_performance_tier = 'average') AS average_campaigns,
    count(*) FILTER (cpl_performance_tier = 'below_average') AS below_avg_campaigns,
    round(CASE WHEN sum(clicks) > 0 THEN sum(leads) / sum(clicks) END, 4) AS overall_conversion_rate,
    round(CASE WHEN sum(leads) > 0 THEN sum(actual_spend) / sum(leads) END, 4) AS blended_cpl,
    max(extracted_at) AS last_updated FROM {src} GROUP BY 1)"""

HEALTH = tb.with_tables("opps", "waterfall") + """,
health AS (SELECT o.partner_name, opportunity_name, stage, amount, close_date, probability, budgets AS partner_budget,
    starting_clients, ending_clients, new_clients, churned_clients,
    CASE WHEN stage = 'Closed Won' THEN 'won' WHEN stage = 'Closed Lost' THEN 'lost'
         WHEN close_date < DATE '2001-08-01' THEN 'overdue' WHEN close_date <= DATE '2001-08-31' THEN 'closing_soon'
         ELSE 'pipeline' END AS pipeline_status, created_date, last_modified_date
  FROM opps o LEFT JOIN waterfall w ON o.partner_name = w.advertiser_name AND o.created_date = w.snapshot_date)"""

HEALTH_COLUMNS = """partner_name, opportunity_name, stage, amount, close_date, probability, partner_budget,
  starting_clients, ending_clients, new_clients, churned_clients, pipeline_status, created_date, last_modified_date"""


def performance(spark, sf, latest=True):
    return ops.campaign_performance(tb.campaigns(spark, sf), tb.brand_benchmarks(spark, sf), latest)


def health(spark, sf):
    return ops.partner_pipeline_health(tb.opportunities(spark, sf), tb.partner_waterfall(spark, sf), tb.AS_OF)


def recent(perf):
    """The input of the 12-month dashboard."""
    return ops.executive_dashboard(perf, tb.AS_OF)


def report(spark, sf, name, **kwargs):
    views = reports.ReportViews(
        lambda: performance(spark, sf),
        lambda: health(spark, sf),
        lambda: recent(performance(spark, sf)),
        lambda: quality(spark, sf),
    )
    return reports.build_report(name, views, tb.AS_OF, **kwargs)


def quality(spark, sf):
    return ops.data_quality_monitor(
        tb.campaigns(spark, sf), tb.brand_benchmarks(spark, sf), tb.opportunities(spark, sf)
    )


@query("campaign_performance", f"{PERF} SELECT {PERF_COLUMNS} FROM perf")
def _(spark, sf):
    return performance(spark, sf)


@query("campaign_performance_every_snapshot", f"""{PERF.replace("newest b", "brand b")} SELECT {PERF_COLUMNS} FROM perf""")
def _(spark, sf):
    return performance(spark, sf, latest=False)


@query("executive_dashboard", f"""{PERF}, {DASH.format(src="(SELECT * FROM perf WHERE snapshot_date >= DATE '2000-08-01')")}
SELECT * FROM dash""")
def _(spark, sf):
    return rounded(recent(performance(spark, sf)), 4)


@query("executive_dashboard_all_months", f"""{PERF}, {DASH.format(src="perf")} SELECT * FROM dash""")
def _(spark, sf):
    return rounded(ops.executive_dashboard(performance(spark, sf)), 4)


@query("executive_dashboard_refreshed", f"""{PERF}, {DASH.format(src="perf")} SELECT * FROM dash""")
def _(spark, sf):
    """Partials of every day but the newest are stored, then the newest day alone refreshes them."""
    perf = performance(spark, sf)
    days = sorted(r[0] for r in perf.select("snapshot_date").distinct().collect())  # one row per day
    root = shared_folder(spark, "dashboard-partials")
    incremental.refresh_dashboard(perf, days[:-1], root)
    return rounded(incremental.refresh_dashboard(perf.where(F.col("snapshot_date") == days[-1]), days[-1:], root), 4)


@query("dashboard_latest_months", f"""{PERF}, {DASH.format(src="perf")} SELECT * FROM dash ORDER BY month DESC LIMIT 6""")
def _(spark, sf):
    return rounded(ops.latest_months(ops.executive_dashboard(performance(spark, sf)), 6), 4)


SUMMARY = """SELECT count(*) AS total_campaigns, count(DISTINCT advertiser_name) AS unique_advertisers,
  count(DISTINCT channel) AS unique_channels, round(coalesce(sum(actual_spend), 0), 4) AS total_spend,
  CAST(coalesce(sum(leads), 0) AS BIGINT) AS total_leads, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS total_clicks,
  round(avg(actual_cpl), 4) AS avg_cpl, round(avg(actual_cpc), 4) AS avg_cpc,
  round(avg(conversion_rate), 4) AS avg_conversion_rate,
  count(*) FILTER (cpl_performance_tier = 'excellent') AS excellent_count,
  count(*) FILTER (cpl_performance_tier = 'good') AS good_count,
  count(*) FILTER (cpl_performance_tier = 'average') AS average_count,
  count(*) FILTER (cpl_performance_tier = 'below_average') AS below_avg_count FROM perf """


@query("campaign_summary_last_30_days", f"{PERF} {SUMMARY} WHERE snapshot_date BETWEEN DATE '2001-07-02' AND DATE '2001-08-01'")
def _(spark, sf):
    return rounded(ops.campaign_summary(performance(spark, sf), tb.AS_OF), 4)


@query("campaign_summary_range", f"{PERF} {SUMMARY} WHERE snapshot_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def _(spark, sf):
    return rounded(ops.campaign_summary(performance(spark, sf), dt.date(2000, 12, 31), dt.date(1996, 1, 1)), 4)


@query("performance_filtered", f"""{PERF} SELECT {PERF_COLUMNS} FROM perf WHERE snapshot_date >= DATE '1999-01-01'
AND snapshot_date <= DATE '2000-06-30' AND channel = '1-URGENT' AND cpl_performance_tier = 'good'""")
def _(spark, sf):
    return ops.filter_performance(
        performance(spark, sf), dt.date(1999, 1, 1), dt.date(2000, 6, 30), "1-URGENT", "good")


@query("top_campaigns", f"""{PERF} SELECT {PERF_COLUMNS} FROM (SELECT * FROM perf
ORDER BY snapshot_date DESC, actual_spend DESC NULLS LAST, campaign_id LIMIT 100)""")
def _(spark, sf):
    return ops.top_campaigns(performance(spark, sf), 100)


def _trend_sql(metric, period, where=""):
    value = {"cpl": "avg(actual_cpl)", "cpc": "avg(actual_cpc)", "conversion_rate": "avg(conversion_rate)",
             "spend": "sum(actual_spend)"}[metric]
    return f"""{PERF} SELECT CAST(date_trunc('{period}', snapshot_date) AS DATE) AS period,
  round({value}, 4) AS metric_value, count(*) AS campaign_count, count(DISTINCT advertiser_name) AS advertiser_count
FROM perf {where} GROUP BY 1 ORDER BY 1 DESC LIMIT 24"""


def _trend(metric, period, channel=None):
    return lambda spark, sf: rounded(ops.performance_trend(performance(spark, sf), metric, period, channel), 4)


query("trend_cpl_month", _trend_sql("cpl", "month"))(_trend("cpl", "month"))
query("trend_cpc_week", _trend_sql("cpc", "week"))(_trend("cpc", "week"))
query("trend_spend_day", _trend_sql("spend", "day"))(_trend("spend", "day"))
query("trend_conversion_rate_channel", _trend_sql("conversion_rate", "month", "WHERE channel = '2-HIGH'"))(
    _trend("conversion_rate", "month", "2-HIGH"))
query("trend_unknown_period_is_month", _trend_sql("spend", "month"))(_trend("spend", "quarter"))


@query("partner_pipeline_health", f"{HEALTH} SELECT {HEALTH_COLUMNS} FROM health")
def _(spark, sf):
    return health(spark, sf)


@query("partner_pipeline_filtered", f"""{HEALTH} SELECT {HEALTH_COLUMNS} FROM health
WHERE stage = 'Proposal' AND partner_name ILIKE '%PPLIER#00000000_%'""")
def _(spark, sf):
    return ops.filter_pipeline(health(spark, sf), "Proposal", "PPLIER#00000000_")


@query("top_opportunities", f"""{HEALTH} SELECT {HEALTH_COLUMNS} FROM (SELECT * FROM health
ORDER BY amount DESC NULLS LAST, close_date ASC NULLS LAST, opportunity_name LIMIT 200)""")
def _(spark, sf):
    return ops.top_opportunities(health(spark, sf), 200)


QUALITY = tb.with_tables("camp", "brand", "opps") + """,
quality AS (SELECT 'campaigns' AS source_table, count(*) AS record_count,
    count(*) FILTER (amount_spent IS NULL) AS null_spend_count, count(*) FILTER (running_cid_leads = 0) AS zero_leads_count,
    min(snapshot_date) AS earliest_date, max(snapshot_date) AS latest_date, max(extracted_at) AS last_extraction FROM camp
  UNION ALL SELECT 'benchmark_data', count(*), count(*) FILTER (cpl_median IS NULL), count(*) FILTER (sample_size < 10),
    min(snapshot_date), max(snapshot_date), max(CAST(snapshot_date AS TIMESTAMP)) FROM brand
  UNION ALL SELECT 'partner_pipeline', count(*), count(*) FILTER (amount IS NULL), count(*) FILTER (stage IS NULL),
    min(created_date), max(created_date), max(last_modified_date) FROM opps)"""


@query("data_quality_monitor", f"{QUALITY} SELECT * FROM quality")
def _(spark, sf):
    return quality(spark, sf)


@query("quality_report", f"""{QUALITY} SELECT source_table, record_count, null_spend_count AS null_count,
zero_leads_count AS low_count, strftime(earliest_date, '%Y-%m-%d') AS earliest_date,
strftime(latest_date, '%Y-%m-%d') AS latest_date FROM quality""")
def _(spark, sf):
    return ops.quality_report(quality(spark, sf))


@query("report_campaign_performance", f"""{PERF} SELECT * EXCLUDE (benchmark_cpc_median, extracted_at) FROM (
SELECT {PERF_COLUMNS} FROM perf) WHERE snapshot_date BETWEEN DATE '2001-07-02' AND DATE '2001-08-01' AND channel = '3-MEDIUM'""")
def _(spark, sf):
    return report(spark, sf, "campaign_performance", filters={"channel": "3-MEDIUM"})


@query("report_partner_pipeline", f"""{HEALTH} SELECT * EXCLUDE (starting_clients, ending_clients, new_clients, churned_clients)
FROM (SELECT {HEALTH_COLUMNS} FROM health) WHERE created_date BETWEEN DATE '2001-05-03' AND DATE '2001-08-01'""")
def _(spark, sf):
    return report(spark, sf, "partner_pipeline")


@query("report_executive_summary", f"""{PERF}, {DASH.format(src="(SELECT * FROM perf WHERE snapshot_date >= DATE '2000-08-01')")}
SELECT * EXCLUDE (last_updated) FROM dash WHERE month BETWEEN DATE '2001-01-01' AND DATE '2001-08-01'""")
def _(spark, sf):
    return rounded(report(spark, sf, "executive_summary", start=dt.date(2001, 1, 15)), 4)


@query("report_data_quality", f"{QUALITY} SELECT source_table, record_count, earliest_date, latest_date, last_extraction FROM quality")
def _(spark, sf):
    return report(spark, sf, "data_quality")


@query("report_json_rows", f"""{PERF}, {DASH.format(src="perf")} SELECT strftime(month, '%Y-%m-%d') AS month,
CAST(total_campaigns AS DOUBLE) AS total_campaigns, total_spend, CAST(total_leads AS DOUBLE) AS total_leads,
blended_cpl, strftime(last_updated, '%Y-%m-%dT%H:%M:%S') AS last_updated FROM dash""")
def _(spark, sf):
    board = rounded(ops.executive_dashboard(performance(spark, sf)), 4).select(
        "month", "total_campaigns", "total_spend", "total_leads", "blended_cpl", "last_updated")
    return board.select(*reports.json_ready(board))


@query("campaigns_zero_as_missing", f"""{tb.with_tables("camp")} SELECT campaign_id, nullif(amount_spent, 0) AS amount_spent,
nullif(running_cid_leads, 0) AS running_cid_leads, nullif(cpl_goal, 0) AS cpl_goal FROM camp""")
def _(spark, sf):
    rows = tb.campaigns(spark, sf).select("campaign_id", "amount_spent", "running_cid_leads", "cpl_goal")
    return ops.hide_zeros(rows, ["amount_spent", "running_cid_leads", "cpl_goal"])
