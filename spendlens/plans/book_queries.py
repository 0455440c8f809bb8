"""Book, partner and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book as ops
from ..operators.risk import heuristic
from . import scoring
from . import testbed as tb
from .registry import query, rounded
from .risk_queries import TO_CHURN, TO_TIER, ranked_rows

# The heuristic scorer's input, derived from the campaign table.
HEURISTIC_COLUMNS = {
    "cost_per_lead": "running_cid_cpl",
    "total_leads": "running_cid_leads",
    "utilization": "utilization * 40",
    "months_running": "true_months_running",
}

HEUR = tb.with_tables("camp") + """,
h0 AS (SELECT * EXCLUDE (utilization), utilization * 40 AS util_pct, CASE WHEN running_cid_cpl <> 0 AND coalesce(cpl_goal, 100) > 0 THEN running_cid_cpl / coalesce(cpl_goal, 100e0) ELSE 1e0 END AS r,
    floor(running_cid_leads * 1.2e0) AS expected FROM camp),
h1 AS (SELECT *, CASE WHEN r >= 3 THEN 0.15e0 WHEN r >= 1.5e0 THEN 0.08e0 WHEN r <= 0.8e0 THEN -0.05e0 ELSE 0e0 END AS a1,
    CASE WHEN running_cid_leads = 0 THEN 0.2e0 WHEN running_cid_leads < expected * 0.5e0 THEN 0.1e0 WHEN running_cid_leads >= expected THEN -0.06e0 ELSE 0e0 END AS a2,
    CASE WHEN util_pct <> 0 AND util_pct / 100 < 0.7e0 THEN 0.05e0 ELSE 0e0 END AS a3,
    CASE WHEN true_months_running <> 0 AND true_months_running <= 1 THEN 0.12e0 WHEN true_months_running <> 0 AND true_months_running <= 3 THEN 0.06e0 ELSE 0e0 END AS a4 FROM h0),
heur AS (SELECT *, greatest(least(0.08e0 + a1 + a2 + a3 + a4, 0.45e0), 0.02e0) AS hp,
    CASE WHEN hp >= 0.3e0 THEN 'P1 - CRITICAL' WHEN hp >= 0.2e0 THEN 'P2 - HIGH' WHEN hp >= 0.1e0 THEN 'P3 - MEDIUM' ELSE 'P4 - LOW' END AS htier,
    least(greatest(hp * 200, 0), 100) AS hscore FROM h1)"""


def heuristic_rows(spark, sf):
    rows = tb.campaigns(spark, sf)
    rows = rows.withColumns({n: F.expr(e) for n, e in HEURISTIC_COLUMNS.items()})
    return heuristic.score_heuristic(rows)


@query("heuristic_scores", f"""{HEUR} SELECT campaign_id, round(hp, 6) AS churn_prob, htier AS priority_tier, round(hscore, 6) AS flare_score,
CAST(floor(hp * 100 * 0.6e0) AS INTEGER) AS baseline FROM heur""")
def _(spark, sf):
    return rounded(heuristic_rows(spark, sf).select(
        "campaign_id", "churn_prob", "priority_tier", "flare_score", "risk_drivers.baseline"))


@query("heuristic_drivers", f"""{HEUR}, d AS (
  SELECT campaign_id, 1 AS pos, CASE WHEN a1 > 0.1e0 THEN 'High CPL (≥3× goal)' WHEN a1 > 0 THEN 'Elevated CPL' ELSE 'Good CPL Performance (protective)' END AS name,
    CASE WHEN a1 > 0.1e0 THEN 25 WHEN a1 > 0 THEN 12 ELSE -8 END AS impact FROM heur WHERE a1 <> 0
  UNION ALL SELECT campaign_id, 2, CASE WHEN a2 > 0.15e0 THEN 'Zero Leads (30d)' WHEN a2 > 0 THEN 'Lead deficit (≤50% plan)' ELSE 'Good Lead Volume (protective)' END,
    CASE WHEN a2 > 0.15e0 THEN 30 WHEN a2 > 0 THEN 15 ELSE -10 END FROM heur WHERE a2 <> 0
  UNION ALL SELECT campaign_id, 3, 'Underpacing', 8 FROM heur WHERE a3 <> 0
  UNION ALL SELECT campaign_id, 4, CASE WHEN a4 > 0.1e0 THEN 'Early Account (≤30d)' ELSE 'New Account (≤3m)' END, CASE WHEN a4 > 0.1e0 THEN 18 ELSE 10 END FROM heur WHERE a4 <> 0)
SELECT campaign_id, name, impact FROM d""")
def _(spark, sf):
    return heuristic_rows(spark, sf).select("campaign_id", F.explode("risk_drivers.drivers").alias("d")).select(
        "campaign_id", "d.name", "d.impact")


@query("heuristic_campaigns", f"""{HEUR} SELECT campaign_id, CAST(floor(true_months_running * 30) AS INTEGER) AS days_elapsed,
least(greatest(util_pct * 100, 0), 999.99e0) AS utilization, coalesce(running_cid_cpl, 100e0) * 0.8e0 AS cpl_goal,
CAST(floor(running_cid_leads * 1.1e0) AS INTEGER) AS expected_leads_to_date, 'Month ' || CAST(floor(true_months_running) AS INTEGER) AS cycle_label,
round(hscore * 10, 6) AS priority_index, CASE WHEN hp > 0.25e0 THEN 'Lead Volume' ELSE 'CPL Performance' END AS primary_issue,
CASE WHEN hp > 0.25e0 THEN 'High' WHEN hp > 0.15e0 THEN 'Medium' ELSE 'Low' END AS churn_risk_band, round(campaign_budget * hp, 6) AS revenue_at_risk,
CASE WHEN hscore > 70 THEN 'Red' WHEN hscore > 40 THEN 'Yellow' ELSE 'Green' END AS flare_band,
'Campaign performance requires attention on ' || lower(htier) AS headline_diagnosis, hp < 0.1e0 AS is_safe FROM heur""")
def _(spark, sf):
    rows = heuristic.build_campaigns(heuristic_rows(spark, sf))
    return rows.select(
        "campaign_id", "days_elapsed", "utilization", "cpl_goal", "expected_leads_to_date", "cycle_label",
        F.round("priority_index", 6).alias("priority_index"), "primary_issue", "churn_risk_band",
        F.round("revenue_at_risk", 6).alias("revenue_at_risk"), "flare_band", "headline_diagnosis", "is_safe")


@query("book_summary", f"""{TO_TIER} SELECT count(*) AS total_accounts, count(*) FILTER (priority_tier = 'P1 - URGENT') AS p1_critical,
count(*) FILTER (priority_tier = 'P2 - HIGH') AS p2_high, round(sum(rar), 2) AS budget_at_risk, round(sum(campaign_budget), 2) AS total_budget FROM tier""")
def _(spark, sf):
    return rounded(ops.book_summary(ranked_rows(spark, sf)), 2)


@query("book_summary_without_risk", f"""{HEUR} SELECT count(*) AS total_accounts, count(*) FILTER (htier = 'P1 - CRITICAL') AS p1_critical,
count(*) FILTER (htier = 'P2 - HIGH') AS p2_high, round(coalesce(sum(campaign_budget) FILTER (htier IN ('P1 - CRITICAL', 'P2 - HIGH')), 0), 2) AS budget_at_risk,
round(coalesce(sum(campaign_budget), 0), 2) AS total_budget FROM heur WHERE partner_name = 'NATION_3' AND am = 'AM 2'""")
def _(spark, sf):
    book = heuristic_rows(spark, sf).withColumn("revenue_at_risk", F.lit(None).cast("double"))
    return rounded(ops.book_summary(ops.filter_book(book, partner_name="NATION_3", am="AM 2", gm=None)), 2)


@query("book_facets", f"""{tb.with_tables("camp")} SELECT DISTINCT 'partners' AS facet, partner_name AS value FROM camp
UNION SELECT 'ams', am FROM camp UNION SELECT 'optimizers', optimizer FROM camp UNION SELECT 'gms', gm FROM camp""")
def _(spark, sf):
    return ops.book_facets(tb.campaigns(spark, sf))


@query("accounts_filtered", f"""{TO_CHURN} SELECT campaign_id, advertiser_name, round(rar, 6) AS revenue_at_risk, round(p, 6) AS churn_prob_90d FROM churn
WHERE partner_name = 'NATION_7' AND optimizer = 'OPT 4'""")
def _(spark, sf):
    rows = scoring.score_risk(ops.filter_book(tb.campaigns(spark, sf), partner_name="NATION_7", optimizer="OPT 4"))
    return rounded(rows.select("campaign_id", "advertiser_name", "revenue_at_risk", "churn_prob_90d"))


PAGE = """SELECT campaign_id, round(priority_index, 6) AS priority_index, priority_tier FROM tier
ORDER BY priority_index DESC NULLS FIRST, rar DESC NULLS FIRST, p DESC NULLS FIRST, campaign_id LIMIT 50"""


@query("accounts_deep_page", f"{TO_TIER} {PAGE} OFFSET 9950")
def _(spark, sf):
    page = ops.directory_page(ops.page_directory(ranked_rows(spark, sf)), 200)
    return rounded(page.select("campaign_id", "priority_index", "priority_tier"))


@query("accounts_second_page", f"{TO_TIER} {PAGE} OFFSET 50")
def _(spark, sf):
    return rounded(ops.account_page(ranked_rows(spark, sf), 2).select("campaign_id", "priority_index", "priority_tier"))


@query("partner_rollup", f"""{HEUR} SELECT partner_name, round(sum(campaign_budget), 2) AS total_budget,
count(*) FILTER (coalesce(true_product_count, 1) = 1) AS single_product_count, count(*) FILTER (true_product_count = 2) AS two_product_count,
count(*) FILTER (true_product_count > 2) AS three_plus_product_count, count(*) FILTER (coalesce(true_product_count, 1) = 1) AS cross_sell_ready_count,
count(*) FILTER (htier IN ('P3 - MEDIUM', 'P4 - LOW')) AS upsell_ready_count FROM heur GROUP BY 1""")
def _(spark, sf):
    return rounded(ops.partner_rollup(heuristic_rows(spark, sf)), 2)


@query("advertiser_rollup", f"""{tb.with_tables("camp")} SELECT partner_name, advertiser_name, count(*) AS campaign_count,
round(sum(campaign_budget), 2) AS total_budget, string_agg(DISTINCT business_category, '|' ORDER BY business_category) AS products FROM camp GROUP BY 1, 2""")
def _(spark, sf):
    rows = ops.advertiser_rollup(tb.campaigns(spark, sf))
    return rounded(rows.select(
        "partner_name", "advertiser_name", F.col("campaign_count"), "total_budget",
        F.array_join("products", "|").alias("products")), 2)


OPPORTUNITY = HEUR + """,
opp AS (SELECT partner_name, CASE coalesce(true_product_count, 1) WHEN 1 THEN 'single_ready' WHEN 2 THEN 'two_ready' ELSE 'three_plus_ready' END AS opportunity_group,
    campaign_id, advertiser_name, campaign_budget AS budget, NULL::BIGINT AS recommended_budget FROM heur
  UNION ALL SELECT partner_name, 'scale_ready', campaign_id, advertiser_name, campaign_budget, CAST(floor(campaign_budget * 1.25e0 + 0.5e0) AS BIGINT)
    FROM heur WHERE campaign_budget >= 2500 AND htier IN ('P3 - MEDIUM', 'P4 - LOW')
  UNION ALL SELECT partner_name, 'too_low', campaign_id, advertiser_name, campaign_budget, 2500 FROM heur WHERE campaign_budget < 2500)"""


@query("partner_opportunities", f"{OPPORTUNITY} SELECT * FROM opp")
def _(spark, sf):
    return ops.opportunity_rows(heuristic_rows(spark, sf))


@query("partner_opportunity_counts", f"{OPPORTUNITY} SELECT partner_name, opportunity_group, count(*) AS campaigns FROM opp GROUP BY 1, 2")
def _(spark, sf):
    return ops.opportunity_counts(ops.opportunity_rows(heuristic_rows(spark, sf)))


@query("missing_product", """SELECT o_custkey, CASE WHEN NOT list_contains(p, 'Search') THEN 'Search' WHEN NOT list_contains(p, 'SEO') THEN 'SEO'
  WHEN NOT list_contains(p, 'DASH') THEN 'DASH' END AS missing_product FROM (
  SELECT o_custkey, list(DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'Search' WHEN 1 THEN 'SEO' WHEN 2 THEN 'DASH' ELSE 'Chat' END) AS p FROM orders GROUP BY 1)""")
def _(spark, sf):
    owned = tb.table(spark, sf, "orders").select("o_custkey", F.expr(
        "case o_orderkey % 4 when 0 then 'Search' when 1 then 'SEO' when 2 then 'DASH' else 'Chat' end").alias("product"))
    products = owned.groupBy("o_custkey").agg(F.collect_set("product").alias("products"))
    return ops.with_missing_product(products, "products").select("o_custkey", "missing_product")


@query("account_cards", f"""{TO_CHURN}, card AS (SELECT *, CASE WHEN plan_td > 0 THEN floor((running_cid_leads / plan_td - 1) * 100 + 0.5e0) END AS pace FROM churn)
SELECT campaign_id, CASE WHEN is_safe THEN 'safe' WHEN p >= 0.4e0 THEN 'critical' WHEN p >= 0.2e0 THEN 'warning' ELSE 'monitoring' END AS status,
  CAST(pace AS BIGINT) AS lead_pacing_pct, CASE WHEN cpl_goal > 0 AND running_cid_cpl IS NOT NULL THEN CAST(floor((running_cid_cpl / cpl_goal - 1) * 100 + 0.5e0) AS BIGINT) END AS cpl_delta_pct,
  CASE WHEN pace < -25 THEN 'Behind' WHEN pace > 25 THEN 'Ahead' ELSE 'On track' END AS pacing_text, advertiser_name AS display_name,
  true AS show_partner, optimizer || ' / ' || am || ' / ' || gm AS team FROM card""")
def _(spark, sf):
    return ops.account_cards(scoring.score_risk(tb.campaigns(spark, sf))).select(
        "campaign_id", "status", "lead_pacing_pct", "cpl_delta_pct", "pacing_text", "display_name", "show_partner", "team")


@query("positive_pills", f"""{TO_CHURN}, s AS (SELECT *, (running_cid_leads / plan_td - 1) * 100 AS pace FROM churn WHERE is_safe)
SELECT campaign_id, text, type FROM (SELECT campaign_id, 'Performing' AS text, 'success' AS type FROM s
  UNION ALL SELECT campaign_id, 'Good Pacing', 'info' FROM s WHERE pace BETWEEN -25 AND 25
  UNION ALL SELECT campaign_id, 'CPL Below Goal', 'info' FROM s WHERE running_cid_cpl < coalesce(eff, cpl_goal)
  UNION ALL SELECT campaign_id, 'Strong Lead Volume', 'info' FROM s WHERE running_cid_leads > 0 AND running_cid_leads >= plan_td)""")
def _(spark, sf):
    rows = scoring.score_risk(tb.campaigns(spark, sf)).where("is_safe")
    return rows.select("campaign_id", F.explode_outer(ops.positive_pills(rows)).alias("p")).where("p is not null").select("campaign_id", "p.text", "p.type")


@query("cpl_badges", f"""{tb.with_tables("camp")} SELECT campaign_id, CASE WHEN running_cid_cpl / nullif(cpl_goal, 0) <= 1 THEN 'perf-good'
WHEN running_cid_cpl / nullif(cpl_goal, 0) <= 1.2e0 THEN 'perf-ok' WHEN running_cid_cpl / nullif(cpl_goal, 0) IS NOT NULL THEN 'perf-bad' END AS badge,
running_cid_cpl / nullif(cpl_goal, 0) AS cpl_ratio, CAST(floor(running_cid_cpl / nullif(cpl_goal, 0) * 100 + 0.5e0) AS BIGINT) AS pct_of_goal FROM camp""")
def _(spark, sf):
    badge, ratio, pct = ops.cpl_badge("running_cid_cpl", "cpl_goal")
    return tb.campaigns(spark, sf).select("campaign_id", badge.alias("badge"), ratio.alias("cpl_ratio"), pct.alias("pct_of_goal"))


@query("campaign_rollup", f"""{tb.with_tables("hist")} SELECT CAST(campaign_id AS VARCHAR) AS campaign_id, min(maid) AS maid, min(business_name) AS advertiser_name,
min(business_category) AS business_category, min(campaign_name) AS campaign_name, string_agg(DISTINCT channel, ', ' ORDER BY channel) AS channel,
round(sum(spend), 4) AS amount_spent, CAST(sum(leads) AS BIGINT) AS running_cid_leads, round(avg(cost_per_lead), 8) AS running_cid_cpl,
count(*) AS months_of_data, count(*) * 30 AS days_elapsed, round(sum(spend) * 1.2e0, 4) AS campaign_budget, 'P3 - MEDIUM' AS current_priority
FROM hist GROUP BY 1 HAVING sum(leads) > 0 OR sum(spend) > 0""")
def _(spark, sf):
    money = {n: F.round(n, 4) for n in ("amount_spent", "campaign_budget")}
    return ops.campaign_rollup(tb.monthly_history(spark, sf)).select(
        "campaign_id", "maid", "advertiser_name", "business_category", "campaign_name", "channel", "amount_spent",
        "running_cid_leads", F.round("running_cid_cpl", 8).alias("running_cid_cpl"), "months_of_data", "days_elapsed",
        "campaign_budget", "current_priority").withColumns(money)


@query("campaign_roster", f"""{tb.with_tables("hist")} SELECT DISTINCT CAST(campaign_id AS VARCHAR) AS campaign_id, maid, business_name AS advertiser_name,
'Partner' AS partner_name, 1 AS true_product_count, business_category FROM hist""")
def _(spark, sf):
    return ops.roster(tb.monthly_history(spark, sf))


@query("best_row_per_campaign", f"""{tb.with_tables("hist")} SELECT campaign_id, report_month, campaign_budget, total_leads FROM (SELECT *, business_name AS advertiser_name, spend * 1.2e0 AS campaign_budget,
leads AS total_leads, row_number() OVER (PARTITION BY campaign_id ORDER BY spend DESC, leads DESC, report_month DESC) AS rn FROM hist WHERE spend > 0) WHERE rn = 1""")
def _(spark, sf):
    rows = tb.monthly_history(spark, sf).select(
        "campaign_id", "report_month", F.col("business_name").alias("advertiser_name"),
        (F.col("spend") * 1.2).alias("campaign_budget"), F.col("leads").alias("total_leads"))
    return ops.best_row_per_campaign(rows).drop("advertiser_name")


@query("partner_contacts", f"""{tb.with_tables("camp")} SELECT campaign_id, coalesce(s.s_name, am) AS am, 'OPT ' || s.s_suppkey AS optimizer, s.n_name AS gm FROM camp
LEFT JOIN (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey) s ON camp.bid_name = 'BID ' || CAST(s.s_suppkey AS VARCHAR)""")
def _(spark, sf):
    partners = tb.table(spark, sf, "supplier").join(
        tb.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.concat(F.lit("BID "), F.col("s_suppkey").cast("string")).alias("partner_bid"),
             F.col("s_name").alias("am"), F.concat(F.lit("OPT "), F.col("s_suppkey").cast("string")).alias("optimizer"), F.col("n_name").alias("gm"))
    rows = tb.campaigns(spark, sf).withColumnRenamed("bid_name", "bid")
    return ops.with_partner_contacts(rows, partners).select("campaign_id", "am", "optimizer", "gm")


@query("book_overview", f"""{tb.with_tables("camp")} SELECT count(*) AS total_campaigns, count(DISTINCT partner_name) AS unique_partners,
count(DISTINCT advertiser_name) AS unique_advertisers, round(avg(campaign_budget), 4) AS avg_budget, round(sum(amount_spent), 2) AS total_spent,
CAST(sum(running_cid_leads) AS BIGINT) AS total_leads FROM camp""")
def _(spark, sf):
    rows = ops.book_overview(tb.campaigns(spark, sf))
    return rows.withColumns({"avg_budget": F.round("avg_budget", 4), "total_spent": F.round("total_spent", 2)})


@query("history_depth", f"""{tb.with_tables("hist")} SELECT min(report_month) AS earliest, max(report_month) AS latest, count(DISTINCT campaign_id) AS unique_campaigns,
count(*) AS total_records, count(DISTINCT business_name) AS unique_businesses FROM hist""")
def _(spark, sf):
    return ops.history_depth(tb.monthly_history(spark, sf))


@query("history_coverage", f"""{tb.with_tables("camp", "hist")} SELECT count(DISTINCT campaign_id) FILTER (seen) AS with_history, count(*) AS campaigns,
round(count(DISTINCT campaign_id) FILTER (seen) / count(*) * 100, 6) AS share_pct
FROM (SELECT campaign_id, campaign_id IN (SELECT CAST(campaign_id AS VARCHAR) FROM hist) AS seen FROM camp)""")
def _(spark, sf):
    return rounded(ops.history_coverage(tb.campaigns(spark, sf), tb.monthly_history(spark, sf)))


SNAPSHOT_SQL = """snaps AS (SELECT CAST(o_orderdate AS DATE) AS snapshot_date, 'book_' || strftime(o_orderdate, '%Y-%m-%d') || '.csv' AS file_name,
count(*) AS record_count, max(o_orderdate) AS last_modified FROM orders GROUP BY 1, 2)"""


def _snapshots(spark, sf):
    return tb.table(spark, sf, "orders").groupBy(
        F.to_date("o_orderdate").alias("snapshot_date"),
        F.concat(F.lit("book_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".csv")).alias("file_name"),
    ).agg(F.count("*").alias("record_count"), F.max("o_orderdate").alias("last_modified"))


@query("current_snapshot", f"WITH {SNAPSHOT_SQL} SELECT snapshot_date, file_name, record_count FROM snaps ORDER BY snapshot_date DESC, file_name DESC LIMIT 1")
def _(spark, sf):
    rows = _snapshots(spark, sf).withColumn("is_current", F.lit(False))
    return ops.current_snapshot(rows).select("snapshot_date", "file_name", "record_count")


@query("snapshot_registry", f"WITH {SNAPSHOT_SQL} SELECT snapshot_date, file_name, record_count, snapshot_date = (SELECT max(snapshot_date) FROM snaps) AS is_current FROM snaps")
def _(spark, sf):
    return ops.with_current_flag(_snapshots(spark, sf)).select("snapshot_date", "file_name", "record_count", "is_current")
