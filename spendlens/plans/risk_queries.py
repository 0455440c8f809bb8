"""Risk model queries: every step flattened to plain columns so that SQL can check it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.risk import churn, goals, narrative, priority, waterfall
from ..operators.risk.params import LEGACY, RiskParams
from . import scoring
from . import testbed as tb
from .registry import query, rounded

GOALS_SQL = """
prep AS (SELECT * REPLACE (coalesce(CASE WHEN u > 0 AND u <= 2 THEN u
      WHEN ideal <> 0 THEN greatest(least(amount_spent / ideal, 2e0), 0e0) END, 0e0) AS utilization)
  FROM (SELECT *, CASE WHEN utilization >= 3 THEN utilization / 100 ELSE utilization END AS u,
      campaign_budget / coalesce(nullif(io_cycle * 30.4e0, 0), 30.4e0) * days_elapsed AS ideal FROM camp)),
goal1 AS (SELECT *, CASE WHEN cpl_goal IS NULL OR cpl_goal = 0 THEN 'missing' WHEN cpl_goal < bsc_cpl_avg * 0.5e0 THEN 'too_low'
      WHEN cpl_goal > bsc_cpl_avg * 1.5e0 THEN 'too_high' ELSE 'reasonable' END AS goal_quality,
    CASE WHEN running_cid_leads = 0 AND amount_spent > 100 THEN 'CONVERSION_FAILURE'
      WHEN utilization < 0.5e0 THEN 'UNDERPACING' ELSE 'MONITORING' END AS issue_category FROM prep),
goal AS (SELECT *, CASE WHEN eff > 0 THEN (running_cid_cpl / eff - 1) * 100 ELSE 0e0 END AS cpl_variance_pct,
    running_cid_cpl - eff AS cpl_delta FROM (SELECT *,
      CASE WHEN goal_quality IN ('missing', 'too_low') THEN bsc_cpl_avg ELSE cpl_goal END AS eff,
      CASE WHEN goal_quality <> 'reasonable' THEN bsc_cpl_avg WHEN bsc_cpl_avg IS NULL THEN NULL
        ELSE least(greatest(cpl_goal, bsc_cpl_avg * 0.8e0), bsc_cpl_avg * 1.2e0) END AS risk_goal,
      goal_quality IN ('missing', 'too_low') AS goal_was_substituted FROM goal1))"""

CHURN_SQL = GOALS_SQL + """,
plan0 AS (SELECT *, coalesce(nullif(eff, 0), bsc_cpl_avg, 150e0) AS plan_goal, least(days_elapsed / avg_cycle_length, 1e0) AS progress,
    CAST(days_elapsed AS DOUBLE) AS d FROM goal),
plan1 AS (SELECT *, least(campaign_budget / greatest(plan_goal, 1e0), 999e0) AS month_plan,
    greatest(campaign_budget / greatest(plan_goal, 1e0) * progress, 0.1e0) AS full_plan FROM plan0),
plan2 AS (SELECT *, least(greatest(month_plan * progress, 0.1e0), 999e0) AS plan_td,
    least(amount_spent / greatest(greatest(campaign_budget, 10e0) * progress, 1e0), 2e0) AS spend_progress,
    CASE WHEN eff <> 0 THEN coalesce(running_cid_cpl, 0) / eff ELSE 1e0 END AS r0,
    campaign_budget >= 2500 OR campaign_budget / avg_cycle_length / coalesce(bsc_cpc_average, 3e0) >= 3 OR month_plan >= 3 AS viable,
    round_even((greatest(io_cycle - 1, 0) * avg_cycle_length + d) / 30e0 * 10e0, 0) / 10e0 AS months FROM plan1),
flag0 AS (SELECT *, coalesce(r0, 1e0) AS cpl_ratio, least(running_cid_leads / greatest(plan_td, 0.1e0), 10e0) AS lead_ratio,
    CASE WHEN months <= 3 THEN 'LTE_90D' WHEN months <= 6 THEN 'M3_6' ELSE 'GT_6' END AS tenure,
    running_cid_leads = 0 AND d >= 30 AND amount_spent >= 250 AND spend_progress >= 0.7e0 AND viable AS zero_month,
    running_cid_leads = 0 AND d >= 5 AND d < 30 AND amount_spent >= 250 AND plan_td >= 1 AND spend_progress >= 0.5e0
      AND viable AS zero_emerging,
    running_cid_leads = 0 AND d >= 5 AND amount_spent < 250 AS zero_idle,
    coalesce(running_cid_cpl, 999e0) AS c9, coalesce(bsc_cpl_avg, 150e0) AS b15, coalesce(cpl_goal, 0e0) AS g0 FROM plan2),
flag AS (SELECT *, NOT zero_month AND NOT zero_emerging AND (
      (d >= 2 AND d <= 7 AND amount_spent >= 500 AND running_cid_leads >= 3 AND c9 <= b15 * 2)
      OR (c9 <= coalesce(eff, g0) * 1.1e0 AND lead_ratio >= 0.8e0 AND d >= 10 AND running_cid_leads >= 3)
      OR (c9 <= b15 * 0.5e0 AND running_cid_leads >= 10)
      OR (d < 30 AND d >= 5 AND (lead_ratio >= 0.6e0 OR running_cid_leads >= 1) AND c9 <= b15 * 0.8e0 AND amount_spent >= 300)
      OR (d < 30 AND d >= 3 AND running_cid_leads >= 1 AND c9 <= b15 * 0.7e0 AND amount_spent >= 100)
      OR (g0 > 0 AND c9 <= g0 * 0.8e0 AND running_cid_leads >= 1)) AS is_safe,
    CASE WHEN cpl_ratio >= 1.2e0 THEN least(1 + 0.55e0 * ((cpl_ratio - 1) * (cpl_ratio - 1)), 1.8e0) END AS f_cpl,
    CASE WHEN full_plan >= 1 AND eff IS NOT NULL AND viable THEN
      CASE WHEN running_cid_leads / full_plan <= 0.25e0 AND spend_progress >= 0.5e0 AND d >= 7 THEN 2.8e0
           WHEN running_cid_leads / full_plan <= 0.5e0 AND spend_progress >= 0.4e0 AND d >= 5 THEN 1.6e0 END END AS f_deficit,
    CASE WHEN zero_emerging THEN 1.8e0 END AS f_zero_emerging, CASE WHEN zero_month THEN 2.5e0 END AS f_zero_month,
    CASE WHEN advertiser_product_count = 1 THEN 1.35e0 END AS f_single,
    CASE tenure WHEN 'LTE_90D' THEN 0.11e0 WHEN 'M3_6' THEN 0.08e0 ELSE 0.05e0 END AS base_p FROM flag0),
odds AS (SELECT *, base_p / (1 - base_p) AS o0, o0 * coalesce(f_cpl, 1e0) AS o1, o1 * coalesce(f_deficit, 1e0) AS o2,
    o2 * coalesce(f_zero_emerging, 1e0) AS o3, o3 * coalesce(f_zero_month, 1e0) AS o4, o4 * coalesce(f_single, 1e0) AS o5 FROM flag),
churn AS (SELECT *, o5 / (1 + o5) AS p_raw, CASE WHEN is_safe THEN least(o5 / (1 + o5), base_p) ELSE o5 / (1 + o5) END AS p,
    campaign_budget * p AS rar,
    CASE WHEN p <= 0.15e0 THEN 'LOW' WHEN p <= 0.30e0 THEN 'MEDIUM' WHEN p <= 0.45e0 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM odds)"""

POINTS_SQL = """
points AS (SELECT *,
    round_even((o1 / (1 + o1) - o0 / (1 + o0)) * 100 * 10, 0) / 10 AS pp1, round_even((o2 / (1 + o2) - o1 / (1 + o1)) * 100 * 10, 0) / 10 AS pp2,
    round_even((o3 / (1 + o3) - o2 / (1 + o2)) * 100 * 10, 0) / 10 AS pp3, round_even((o4 / (1 + o4) - o3 / (1 + o3)) * 100 * 10, 0) / 10 AS pp4,
    round_even((o5 / (1 + o5) - o4 / (1 + o4)) * 100 * 10, 0) / 10 AS pp5 FROM churn),
drivers AS (
  SELECT campaign_id, 1 AS seq, CASE WHEN cpl_ratio >= 3 THEN 'High CPL (≥3× goal)' WHEN cpl_ratio >= 1.5e0 THEN 'Elevated CPL (1.5–3×)'
      ELSE 'CPL above goal (1.2–1.5×)' END AS name, pp1 AS points, true AS is_controllable, f_cpl AS lift_x FROM points WHERE f_cpl IS NOT NULL
  UNION ALL SELECT campaign_id, 2, CASE WHEN f_deficit > 2 THEN 'Severe lead deficit (≤25% of plan)' ELSE 'Moderate lead deficit (≤50% of plan)' END,
      pp2, true, f_deficit FROM points WHERE f_deficit IS NOT NULL
  UNION ALL SELECT campaign_id, 3, 'Zero leads (emerging)', pp3, true, f_zero_emerging FROM points WHERE f_zero_emerging IS NOT NULL
  UNION ALL SELECT campaign_id, 4, 'Zero leads (30+ days)', pp4, true, f_zero_month FROM points WHERE f_zero_month IS NOT NULL
  UNION ALL SELECT campaign_id, 5, 'Single Product', pp5, false, f_single FROM points WHERE f_single IS NOT NULL)"""

INDEX_SQL = """
idx AS (SELECT *, exp(0.6e0 * ln(rar + 1e-12) + 0.4e0 * ln(p + 1e-12)) * CASE WHEN is_safe THEN 0.05e0 ELSE 1e0 END AS priority_index FROM churn),
ranked AS (SELECT *, (rank() OVER (ORDER BY priority_index) + (count(*) OVER (PARTITION BY priority_index) - 1) / 2e0) / count(*) OVER () AS pct FROM idx),
flare AS (SELECT *, CASE WHEN is_safe THEN least(100 * pct, 15e0) ELSE 100 * pct END AS flare_score_raw,
    CAST(CASE WHEN is_safe THEN least(round_even(100 * pct, 0), 15) ELSE round_even(100 * pct, 0) END AS INTEGER) AS flare_score,
    CASE WHEN is_safe OR pct <= 0.45e0 THEN 'low' WHEN pct <= 0.65e0 THEN 'moderate' WHEN pct <= 0.85e0 THEN 'high' ELSE 'critical' END AS flare_band FROM ranked),
tier0 AS (SELECT *, coalesce(CASE WHEN campaign_budget / avg_cycle_length * days_elapsed <> 0 THEN
      amount_spent / (campaign_budget / avg_cycle_length * days_elapsed) END, 0e0) AS own_progress, running_cid_leads / plan_td AS share FROM flare),
tier AS (SELECT *, CASE WHEN is_safe THEN 'P0 - SAFE'
    WHEN zero_month OR zero_emerging OR cpl_ratio >= 3 OR (plan_td >= 1 AND share <= 0.25e0 AND own_progress >= 0.5e0 AND days_elapsed >= 7)
      OR (running_cid_leads = 0 AND days_elapsed >= 14 AND own_progress >= 0.5e0)
      OR (flare_band = 'critical' AND p >= 0.4e0) THEN 'P1 - URGENT'
    WHEN cpl_ratio >= 1.5e0 OR (plan_td >= 1 AND share <= 0.5e0 AND own_progress >= 0.4e0 AND days_elapsed >= 5)
      OR flare_band = 'high' OR p >= 0.25e0 THEN 'P2 - HIGH' ELSE 'P3 - MONITOR' END AS priority_tier FROM tier0)"""

CAMP = tb.with_tables("camp")
TO_CHURN = f"{CAMP},{CHURN_SQL}"
TO_DRIVERS = f"{TO_CHURN},{POINTS_SQL}"
TO_TIER = f"{TO_CHURN},{INDEX_SQL}"


def scored_rows(spark, sf):
    return scoring.score_risk(tb.campaigns(spark, sf))


def ranked_rows(spark, sf):
    return priority.priority_tier(priority.priority_score(scored_rows(spark, sf)))


@query("goals_and_issues", f"""{CAMP},{GOALS_SQL} SELECT campaign_id, round(utilization, 9) AS utilization, goal_quality, issue_category,
eff AS effective_cpl_goal, risk_goal AS risk_cpl_goal, goal_was_substituted, round(cpl_delta, 9) AS cpl_delta,
round(cpl_variance_pct, 9) AS cpl_variance_pct FROM goal""")
def _(spark, sf):
    return rounded(goals.set_goals(goals.prepare_campaigns(tb.campaigns(spark, sf))).select(
        "campaign_id", "utilization", "goal_quality", "issue_category", "effective_cpl_goal", "risk_cpl_goal",
        "goal_was_substituted", "cpl_delta", "cpl_variance_pct"), 9)


@query("expected_leads", f"""{CAMP},{GOALS_SQL}, lead0 AS (SELECT *,
  CASE WHEN bsc_cpc_average > 0 THEN greatest(least(bsc_cpc_average / coalesce(bsc_cpl_avg, 150e0), 0.25e0), 0.01e0) ELSE 0.06e0 END AS cr,
  coalesce(risk_goal, 150e0) AS target FROM goal),
lead AS (SELECT *, coalesce(campaign_budget / bsc_cpc_average * cr, campaign_budget / nullif(target, 0)) AS monthly FROM lead0)
SELECT campaign_id, round(least(greatest(monthly, 0), 1e6), 9) AS expected_leads_monthly,
  round(monthly * least(days_elapsed / 30.4e0, 2e0), 9) AS expected_leads_to_date,
  round(CASE WHEN target > 0 THEN amount_spent / target ELSE 0 END, 9) AS expected_leads_to_date_spend FROM lead""")
def _(spark, sf):
    rows = goals.expected_leads(goals.set_goals(goals.prepare_campaigns(tb.campaigns(spark, sf))))
    return rounded(rows.select(
        "campaign_id", "expected_leads_monthly", "expected_leads_to_date", "expected_leads_to_date_spend"), 9)


@query("plan_and_flags", f"""{TO_CHURN} SELECT campaign_id, month_plan AS expected_leads_monthly,
plan_td AS expected_leads_to_date, lead_ratio AS lead_ratio, spend_progress AS spend_progress,
cpl_ratio AS cpl_ratio, viable AS sem_viable, tenure, zero_month AS zero_lead_last_mo,
zero_emerging AS zero_lead_emerging, zero_idle AS zero_lead_idle, is_safe FROM churn""")
def _(spark, sf):
    return scored_rows(spark, sf).select(
        "campaign_id", "expected_leads_monthly", "expected_leads_to_date", F.col("_lead_ratio").alias("lead_ratio"),
        "spend_progress", "cpl_ratio", F.col("_sem_viable").alias("sem_viable"), F.col("_tenure").alias("tenure"),
        "zero_lead_last_mo", "zero_lead_emerging", "zero_lead_idle", "is_safe")


@query("churn_probability", f"""{TO_CHURN} SELECT campaign_id, round(p_raw, 9) AS churn_prob_90d_unclamped, round(p, 9) AS churn_prob_90d,
round(rar, 6) AS revenue_at_risk, band AS churn_risk_band, is_safe FROM churn""")
def _(spark, sf):
    rows = scored_rows(spark, sf)
    return rows.select(
        "campaign_id", F.round("churn_prob_90d_unclamped", 9).alias("churn_prob_90d_unclamped"),
        F.round("churn_prob_90d", 9).alias("churn_prob_90d"), F.round("revenue_at_risk", 6).alias("revenue_at_risk"),
        "churn_risk_band", "is_safe")


STEPS = RiskParams(smooth_cpl=False)


@query("churn_step_table", f"""{TO_CHURN.replace(
    "least(1 + 0.55e0 * ((cpl_ratio - 1) * (cpl_ratio - 1)), 1.8e0)",
    "CASE WHEN cpl_ratio <= 1.2e0 THEN 1.05e0 WHEN cpl_ratio <= 1.5e0 THEN 1.2e0 WHEN cpl_ratio <= 3 THEN 1.6e0"
    " WHEN cpl_ratio <= 999 THEN 2.4e0 END")}
SELECT campaign_id, f_cpl AS cpl_factor, round(p, 9) AS churn_prob_90d FROM churn""")
def _(spark, sf):
    return rounded(scoring.score_risk(tb.campaigns(spark, sf), STEPS).select(
        "campaign_id", F.col("f_cpl").alias("cpl_factor"), "churn_prob_90d"), 9)


@query("churn_strict_rolling_gate", f"""{CAMP}, gated AS (SELECT c.* EXCLUDE (roll), roll FROM (SELECT *, k % 3 AS roll FROM camp) c),
{CHURN_SQL.replace("FROM camp)", "FROM gated)").replace("0.7e0 AND viable AS", "0.7e0 AND viable AND roll = 0 AS").lstrip()}
SELECT campaign_id, zero_month AS zero_lead_last_mo, is_safe, round(p, 9) AS churn_prob_90d FROM churn""")
def _(spark, sf):
    rows = tb.campaigns(spark, sf).withColumn("leads_rolling_30d", F.col("k") % 3)
    return rounded(scoring.score_risk(rows, RiskParams(strict_rolling_gate=True)).select(
        "campaign_id", "zero_lead_last_mo", "is_safe", "churn_prob_90d"), 9)


@query("risk_drivers", f"""{TO_DRIVERS} SELECT campaign_id, name, points, is_controllable, lift_x FROM drivers""")
def _(spark, sf):
    rows = churn.attach_drivers(scored_rows(spark, sf)).select("campaign_id", F.explode_outer("risk_drivers.drivers").alias("d")).where("d is not null")
    return rows.select("campaign_id", "d.name", "d.points", "d.is_controllable", "d.lift_x")


@query("risk_driver_totals", f"""{TO_DRIVERS}, sums AS (SELECT *, CAST(round_even(p_raw * 100, 0) AS INTEGER) AS raw_pct,
  CAST(round_even(base_p * 100, 0) AS INTEGER) AS base_pct, CAST(round_even(p * 100, 0) AS INTEGER) AS pct,
  CASE WHEN f_cpl IS NULL THEN 0 ELSE round_even(pp1, 0) END + CASE WHEN f_deficit IS NULL THEN 0 ELSE round_even(pp2, 0) END
  + CASE WHEN f_zero_emerging IS NULL THEN 0 ELSE round_even(pp3, 0) END + CASE WHEN f_zero_month IS NULL THEN 0 ELSE round_even(pp4, 0) END
  + CASE WHEN f_single IS NULL THEN 0 ELSE round_even(pp5, 0) END AS s FROM points)
SELECT campaign_id, base_pct AS baseline, raw_pct AS p_unclamped_pct, pct AS p_clamped_pct,
  is_safe AND p_raw > p + 0.01e0 AS safe_clamped, abs(base_pct + s - raw_pct) <= 1 AS reconcile_ok FROM sums""")
def _(spark, sf):
    return churn.attach_drivers(scored_rows(spark, sf)).select(
        "campaign_id", "risk_drivers.baseline", "risk_drivers.p_unclamped_pct", "risk_drivers.p_clamped_pct",
        "risk_drivers.safe_clamped", "reconcile_ok")


@query("rescaled_drivers", f"""{TO_DRIVERS}, scale AS (SELECT campaign_id, sum(points) AS have FROM drivers GROUP BY 1)
SELECT d.campaign_id, seq, round(CASE WHEN abs(base_p * 100 + have - 40) > 0.1e0 AND have <> 0
  THEN round_even(points * ((40 - base_p * 100) / have) * 10, 0) / 10 ELSE points END, 6) AS points
FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY seq) - 1 AS pos FROM drivers) d
JOIN scale USING (campaign_id) JOIN churn c USING (campaign_id)""".replace("d.campaign_id, seq,", "d.campaign_id, CAST(pos AS INTEGER) AS seq,"))
def _(spark, sf):
    rows = churn.rescaled_points(churn.attach_drivers(scored_rows(spark, sf)), F.lit(0.40))
    return rows.select("campaign_id", F.posexplode_outer("rescaled_drivers").alias("seq", "d")).where("d is not null").select(
        "campaign_id", "seq", F.round("d.points", 6).alias("points"))


@query("flare_scores", f"""{TO_TIER} SELECT campaign_id, round(priority_index, 6) AS priority_index, round(flare_score_raw, 6) AS flare_score_raw,
flare_score, flare_band, round(rar, 6) AS breakdown_rar, round(p, 6) AS breakdown_churn FROM flare""")
def _(spark, sf):
    rows = priority.priority_score(scored_rows(spark, sf))
    return rounded(rows.select(
        "campaign_id", "priority_index", "flare_score_raw", "flare_score", "flare_band",
        F.col("flare_breakdown.rar").alias("breakdown_rar"), F.col("flare_breakdown.churn").alias("breakdown_churn")))


@query("scored_book_upsert", f"""{TO_TIER} SELECT campaign_id, priority_tier, TIMESTAMP '2025-09-20 06:00:00' AS scored_at FROM tier
WHERE CAST(campaign_id AS BIGINT) % 2 = 0 UNION ALL SELECT campaign_id, 'STORED', TIMESTAMP '2025-09-01 06:00:00' FROM tier
WHERE CAST(campaign_id AS BIGINT) % 2 = 1 AND CAST(campaign_id AS BIGINT) % 3 = 0""")
def _(spark, sf):
    """A stored book of every third campaign meets new scores of every other one."""
    number = F.col("campaign_id").cast("bigint")
    at = lambda day: F.lit(f"2025-09-{day} 06:00:00").cast("timestamp_ntz").alias("scored_at")
    new = ranked_rows(spark, sf).where(number % 2 == 0).select("campaign_id", "priority_tier", at("20"))
    stored = tb.campaigns(spark, sf).where(number % 3 == 0).select("campaign_id", F.lit("STORED").alias("priority_tier"), at("01"))
    return scoring.upsert_book(stored, new, ["campaign_id"])


@query("priority_tiers", f"{TO_TIER} SELECT campaign_id, priority_tier, is_safe FROM tier")
def _(spark, sf):
    return ranked_rows(spark, sf).select("campaign_id", "priority_tier", "is_safe")


@query("priority_tier_counts", f"""{TO_TIER} SELECT priority_tier, flare_band, count(*) AS campaigns, round(sum(rar), 2) AS revenue_at_risk
FROM tier GROUP BY 1, 2""")
def _(spark, sf):
    return ranked_rows(spark, sf).groupBy("priority_tier", "flare_band").agg(
        F.count("*").alias("campaigns"), F.round(F.sum("revenue_at_risk"), 2).alias("revenue_at_risk"))


HEADLINE_SQL = """
head AS (SELECT *, CASE WHEN is_safe THEN 'PERFORMING — ON TRACK'
    WHEN days_elapsed >= 5 AND amount_spent < 250 THEN 'NOT SPENDING — CHECK LIVE STATE'
    WHEN zero_month OR zero_emerging THEN 'ZERO LEADS — NO CONVERSIONS'
    WHEN running_cid_leads = 0 AND days_elapsed >= 5 AND days_elapsed < 30 AND amount_spent >= 250 AND plan_td >= 1 AND (campaign_budget >= 2500
      OR campaign_budget / avg_cycle_length / bsc_cpc_average >= 3 OR month_plan >= 3) THEN 'ZERO LEADS — NO CONVERSIONS'
    WHEN cpl_variance_pct > 300 AND io_cycle <= 3 AND running_cid_leads <= 5 THEN 'CPL CRISIS — NEW ACCOUNT — LOW LEADS'
    WHEN cpl_variance_pct > 100 THEN 'HIGH CPL — $' || CAST(floor(running_cid_cpl) AS BIGINT) || ' vs $' || CAST(floor(eff) AS BIGINT) || ' GOAL'
    WHEN io_cycle <= 3 THEN 'NEW ACCOUNT AT RISK'
    WHEN utilization <> 0 AND utilization < 0.5e0 THEN 'UNDERPACING — ' || CAST(floor((1 - utilization) * 100) AS BIGINT) || '% BEHIND'
    WHEN cpl_variance_pct < -20 THEN 'PERFORMING — ON/UNDER GOAL'
    WHEN goal_quality = 'too_low' THEN 'GOAL MISALIGNED — Reset Required'
    ELSE 'MONITORING FOR CHANGES' END AS headline_diagnosis FROM churn)"""


@query("headlines", f"""{TO_CHURN},{HEADLINE_SQL} SELECT campaign_id, headline_diagnosis, CASE WHEN headline_diagnosis LIKE 'PERFORMING%' THEN 'healthy'
WHEN headline_diagnosis LIKE 'ZERO%' OR headline_diagnosis LIKE 'CPL CRISIS%' THEN 'critical'
WHEN headline_diagnosis LIKE 'HIGH CPL%' THEN CASE WHEN cpl_variance_pct <= 200 THEN 'warning' ELSE 'critical' END
WHEN headline_diagnosis LIKE 'MONITORING%' THEN 'neutral' ELSE 'warning' END AS headline_severity FROM head""")
def _(spark, sf):
    return narrative.attach_headline(scored_rows(spark, sf)).select("campaign_id", "headline_diagnosis", "headline_severity")


@query("diagnosis_pills", f"""{TO_CHURN}, pill AS (
  SELECT campaign_id, 0 AS pos, 'Performing' AS text, 'success' AS type FROM churn WHERE is_safe
  UNION ALL SELECT campaign_id, 1, CASE WHEN zero_month OR zero_emerging THEN 'Zero Leads' WHEN zero_idle THEN 'Zero Leads (Idle)' ELSE 'No Leads Yet' END,
    CASE WHEN zero_month OR zero_emerging THEN 'critical' ELSE 'warning' END FROM churn
    WHERE NOT is_safe AND (zero_month OR zero_emerging OR zero_idle OR (days_elapsed >= 5 AND running_cid_leads = 0 AND viable))
  UNION ALL SELECT campaign_id, 2, 'CPL ' || CASE WHEN trunc(cpl_variance_pct) > 0 THEN '+' ELSE '' END || CAST(trunc(cpl_variance_pct) AS BIGINT) || '%',
    CASE WHEN trunc(cpl_variance_pct) > 200 THEN 'critical' ELSE 'warning' END FROM churn WHERE NOT is_safe AND abs(cpl_variance_pct) > 20
  UNION ALL SELECT campaign_id, 3, 'Early Account', 'warning' FROM churn WHERE NOT is_safe AND true_months_running <= 3
  UNION ALL SELECT campaign_id, 4, 'Single Product', 'neutral' FROM churn WHERE NOT is_safe AND true_product_count = 1
  UNION ALL SELECT campaign_id, 5, 'Pacing -' || CAST(floor((1 - utilization) * 100) AS BIGINT) || '%', 'warning' FROM churn WHERE NOT is_safe AND utilization < 0.5e0
  UNION ALL SELECT campaign_id, 5, 'Pacing +' || CAST(floor((utilization - 1) * 100) AS BIGINT) || '%', 'warning' FROM churn WHERE NOT is_safe AND utilization > 1.25e0
  UNION ALL SELECT campaign_id, 6, 'No Goal', 'warning' FROM churn WHERE NOT is_safe AND goal_quality = 'missing'
  UNION ALL SELECT campaign_id, 6, 'Goal Too Low', 'warning' FROM churn WHERE NOT is_safe AND goal_quality = 'too_low'
  UNION ALL SELECT campaign_id, 7, CASE WHEN rar >= 5000 THEN 'High $ Risk' ELSE '$ Risk' END, CASE WHEN rar >= 5000 THEN 'critical' ELSE 'warning' END
    FROM churn WHERE NOT is_safe AND rar >= 2000)
SELECT campaign_id, CAST(row_number() OVER (PARTITION BY campaign_id ORDER BY pos) - 1 AS INTEGER) AS seq, text, type FROM pill""")
def _(spark, sf):
    rows = narrative.attach_pills(scored_rows(spark, sf)).select("campaign_id", F.posexplode_outer("diagnosis_pills").alias("seq", "p")).where("p is not null")
    return rows.select("campaign_id", "seq", "p.text", "p.type")


@query("goal_advice", f"""{CAMP},{GOALS_SQL}, adv AS (SELECT *, coalesce(bsc_cpl_avg, 150e0) AS p50, nullif(cpl_goal, 0) AS g,
  CASE WHEN nullif(cpl_goal, 0) IS NULL THEN 'missing' WHEN cpl_goal / coalesce(bsc_cpl_avg, 150e0) < 0.5e0 THEN 'too_low'
    WHEN cpl_goal / coalesce(bsc_cpl_avg, 150e0) < 0.7e0 THEN 'ambitious' WHEN cpl_goal / coalesce(bsc_cpl_avg, 150e0) <= 1.5e0 THEN 'reasonable'
    WHEN cpl_goal / coalesce(bsc_cpl_avg, 150e0) <= 2.5e0 THEN 'too_high' ELSE 'wildly_high' END AS status FROM goal),
band AS (SELECT * FROM (VALUES (3e0, 1e300, 'CRISIS (≥3×)'), (2e0, 3e0, 'Major gap (2–3×)'), (1.5e0, 2e0, 'Gap (1.5–2×)')) v(lo, hi, label))
SELECT campaign_id, status, status IN ('missing', 'too_low') AND (days_elapsed >= 7 OR io_cycle >= 1) AS show, p50 * 0.8e0 AS rec_low, p50 * 1.2e0 AS rec_high,
  p50 AS rec_point, g AS goal_advertiser, CASE WHEN g IS NULL THEN '—' ELSE {{vs_goal}} END AS vs_goal, {{vs_rec}} AS vs_recommended,
  'Vertical median (p50) ≈ $' || CAST(round_even(p50, 0) AS INTEGER) || '. Recommended window $' || CAST(round_even(p50 * 0.8e0, 0) AS INTEGER)
  || '–$' || CAST(round_even(p50 * 1.2e0, 0) AS INTEGER) || '.' AS rationale FROM adv""".replace(
    "{vs_goal}", "CASE WHEN running_cid_cpl IS NULL OR running_cid_cpl / g <= 0 THEN '—' WHEN running_cid_cpl / g >= 3 THEN 'CRISIS (≥3×)'"
    " WHEN running_cid_cpl / g >= 2 THEN 'Major gap (2–3×)' WHEN running_cid_cpl / g >= 1.5e0 THEN 'Gap (1.5–2×)'"
    " WHEN running_cid_cpl / g > 1.1e0 THEN 'Slightly high (1.1–1.5×)' WHEN running_cid_cpl / g >= 0.9e0 THEN 'On target (±10%)'"
    " ELSE 'Under target (<0.9×)' END").replace(
    "{vs_rec}", "CASE WHEN running_cid_cpl IS NULL OR running_cid_cpl / p50 <= 0 THEN '—' WHEN running_cid_cpl / p50 >= 3 THEN 'CRISIS (≥3×)'"
    " WHEN running_cid_cpl / p50 >= 2 THEN 'Major gap (2–3×)' WHEN running_cid_cpl / p50 >= 1.5e0 THEN 'Gap (1.5–2×)'"
    " WHEN running_cid_cpl / p50 > 1.1e0 THEN 'Slightly high (1.1–1.5×)' WHEN running_cid_cpl / p50 >= 0.9e0 THEN 'On target (±10%)'"
    " ELSE 'Under target (<0.9×)' END"))
def _(spark, sf):
    rows = narrative.attach_goal_advice(goals.set_goals(goals.prepare_campaigns(tb.campaigns(spark, sf))))
    a = F.col("goal_advice")
    return rows.select(
        "campaign_id", a["status"].alias("status"), a["show"].alias("show"), a["recommended"]["range"][0].alias("rec_low"),
        a["recommended"]["range"][1].alias("rec_high"), a["recommended"]["point"].alias("rec_point"),
        a["goal_advertiser"].alias("goal_advertiser"), a["performance_band"]["vs_goal"].alias("vs_goal"),
        a["performance_band"]["vs_recommended"].alias("vs_recommended"), a["rationale"].alias("rationale"))


@query("recommended_actions", f"""{TO_DRIVERS}, act AS (
  SELECT campaign_id, 0 AS seq, 'Add a second product (e.g., SEO or Website)' AS title, CAST(trunc(points) AS INTEGER) AS impact, 'Start Proposal →' AS cta
    FROM drivers WHERE name = 'Single Product'
  UNION ALL SELECT campaign_id, 1, 'Fix tracking & lead quality audit', CAST(trunc(points) AS INTEGER), 'Open Checklist →' FROM drivers WHERE name = 'Zero leads (30+ days)'
  UNION ALL SELECT campaign_id, 2, 'Budget/keyword optimization for lead volume', CAST(trunc(points) AS INTEGER), 'Open Planner →' FROM drivers WHERE name LIKE '%CPL%')
SELECT campaign_id, title, impact, cta, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY impact DESC, seq) - 1 AS pos
  FROM act WHERE impact > 0) WHERE pos < 3""")
def _(spark, sf):
    rows = narrative.attach_actions(churn.attach_drivers(scored_rows(spark, sf)))
    return rows.select("campaign_id", F.posexplode_outer("actions").alias("pos", "a")).where("a is not null").select(
        "campaign_id", "pos", "a.title", "a.impact", "a.cta")


WATERFALL_SQL = """
wf0 AS (SELECT c.campaign_id, CAST(round_even(p * 100, 0) AS INTEGER) AS total, CAST(round_even(p_raw * 100, 0) AS INTEGER) AS target,
    CAST(round_even(base_p * 100, 0) AS INTEGER) AS base FROM churn c),
wf1 AS (SELECT campaign_id, row_number() OVER (PARTITION BY campaign_id ORDER BY seq) AS pos, count(*) OVER (PARTITION BY campaign_id) AS n,
    name, CAST(round_even(points, 0) AS INTEGER) AS pp, sum(CAST(round_even(points, 0) AS INTEGER)) OVER (PARTITION BY campaign_id) AS s, is_controllable
  FROM drivers WHERE round_even(points, 0) <> 0),
wf AS (SELECT w.campaign_id, pos, name AS label, CAST(pp + CASE WHEN pos = n THEN target - base - s ELSE 0 END AS INTEGER) AS pp, base, total, target,
    CASE WHEN is_controllable THEN 'controllable' ELSE 'structural' END AS type FROM wf1 w JOIN wf0 USING (campaign_id))"""


@query("churn_waterfall", f"""{TO_DRIVERS},{WATERFALL_SQL} SELECT campaign_id, label, pp, type, base AS baseline_pp, total AS total_pct,
target AS math_total_unclamped, CASE WHEN total < target THEN 'SAFE clamp active: displayed churn ' || total || '% < model ' || target || '%.' END AS note FROM wf""")
def _(spark, sf):
    rows = waterfall.waterfall_of_scores(churn.attach_drivers(scored_rows(spark, sf)))
    w = F.col("waterfall")
    return rows.select("campaign_id", w["baseline_pp"].alias("baseline_pp"), w["total_pct"].alias("total_pct"),
                       w["math_total_unclamped"].alias("math_total_unclamped"), w["note"].alias("note"),
                       F.explode_outer(w["drivers"]).alias("d")).where("d is not null").select(
        "campaign_id", "baseline_pp", "total_pct", "math_total_unclamped", "note", "d.label", "d.pp", "d.type")


@query("waterfall_bars", f"""{TO_DRIVERS},{WATERFALL_SQL},
bar AS (SELECT campaign_id, 0 AS pos, 'Baseline' AS label, 'baseline' AS kind, 0e0 AS bar_left, CAST(base AS DOUBLE) AS bar_width, base AS pp FROM wf0
  UNION ALL SELECT campaign_id, pos, label, type, CAST(base + coalesce(sum(pp) OVER (PARTITION BY campaign_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    + least(pp, 0), CAST(abs(pp) AS DOUBLE), pp FROM wf)
SELECT campaign_id, CAST(pos AS INTEGER) AS pos, label, kind, bar_left, bar_width, pp FROM bar""")
def _(spark, sf):
    rows = waterfall.bar_geometry(waterfall.waterfall_of_scores(churn.attach_drivers(scored_rows(spark, sf))))
    return rows.select("campaign_id", F.posexplode_outer("bars").alias("pos", "b")).where("b is not null").select(
        "campaign_id", "pos", "b.label", "b.kind", F.col("b.left").alias("bar_left"), F.col("b.width").alias("bar_width"), "b.pp")


@query("stored_waterfall", f"""{TO_DRIVERS} SELECT campaign_id, CAST(round_even(p * 100, 0) AS INTEGER) AS total_pct,
CAST(round_even(base_p * 100, 0) AS INTEGER) AS baseline_pp, name, CAST(trunc(points) AS INTEGER) AS points FROM drivers JOIN churn USING (campaign_id)""")
def _(spark, sf):
    rows = waterfall.stored_waterfall(churn.attach_drivers(scored_rows(spark, sf)))
    return rows.select("campaign_id", "churn_waterfall.total_pct", "churn_waterfall.baseline_pp",
                       F.explode_outer("churn_waterfall.drivers").alias("d")).where("d is not null").select(
        "campaign_id", "total_pct", "baseline_pp", "d.name", "d.points")


@query("legacy_scores", f"""{CAMP}, leg0 AS (SELECT *, (k * 7) % 60 AS expected_leads_to_date, (k % 21) / 1e1 AS spend_progress, k % 5 <> 0 AS viable,
  k % 6 = 0 AS is_safe, (k % 12 = 0 AND k % 46 >= 30) AS zm, (k % 12 = 0 AND k % 46 BETWEEN 5 AND 29) AS ze,
  CASE WHEN cpl_goal > 0 AND running_cid_cpl > 0 THEN running_cid_cpl / cpl_goal ELSE 1e0 END AS r,
  ((io_cycle - 1) * 30.4e0 + days_elapsed) / 30e0 AS m FROM camp),
leg1 AS (SELECT *, CASE WHEN m <= 3 THEN 0.09e0 WHEN m <= 6 THEN 0.06e0 ELSE 0.05e0 END AS base_p,
  CASE WHEN r >= 1.2e0 THEN least(1 + 0.55e0 * ((r - 1) * (r - 1)), 1.8e0) ELSE 1e0 END AS f1,
  CASE WHEN expected_leads_to_date >= 1 AND viable AND running_cid_leads / expected_leads_to_date <= 0.25e0 AND spend_progress >= 0.5e0 AND days_elapsed >= 7 THEN 2.8e0
       WHEN expected_leads_to_date >= 1 AND viable AND running_cid_leads / expected_leads_to_date <= 0.5e0 AND spend_progress >= 0.4e0 AND days_elapsed >= 5 THEN 1.6e0 ELSE 1e0 END AS f2,
  CASE WHEN ze THEN 1.8e0 ELSE 1e0 END AS f3, CASE WHEN zm THEN 2.5e0 ELSE 1e0 END AS f4, CASE WHEN advertiser_product_count = 1 THEN 1.35e0 ELSE 1e0 END AS f5 FROM leg0),
leg2 AS (SELECT *, base_p / (1 - base_p) * f1 * f2 * f3 * f4 * f5 AS o, o / (1 + o) AS pr, CASE WHEN is_safe THEN least(pr, base_p) ELSE pr END AS p FROM leg1)
SELECT campaign_id, round(pr, 9) AS churn_prob_90d_unclamped, round(p, 9) AS churn_prob_90d, round(campaign_budget * p, 6) AS revenue_at_risk,
  CASE WHEN p <= 0.15e0 THEN 'LOW' WHEN p <= 0.3e0 THEN 'MEDIUM' WHEN p <= 0.45e0 THEN 'HIGH' ELSE 'CRITICAL' END AS churn_risk_band FROM leg2""")
def _(spark, sf):
    k = F.col("k")
    rows = tb.campaigns(spark, sf).withColumns({
        "effective_cpl_goal": F.col("cpl_goal"), "expected_leads_to_date": (k * 7) % 60, "spend_progress": (k % 21) / F.lit(10.0),
        "_sem_viable": k % 5 != 0, "is_safe": k % 6 == 0,
        "zero_lead_last_mo": (k % 12 == 0) & (k % 46 >= 30), "zero_lead_emerging": (k % 12 == 0) & (k % 46).between(5, 29)})
    scored = churn.score_churn_legacy(rows, LEGACY)
    return scored.select(
        "campaign_id", F.round("churn_prob_90d_unclamped", 9).alias("churn_prob_90d_unclamped"),
        F.round("churn_prob_90d", 9).alias("churn_prob_90d"), F.round("revenue_at_risk", 6).alias("revenue_at_risk"), "churn_risk_band")


@query("neutral_scores", f"""{CAMP} SELECT campaign_id, 0.15e0 AS churn_prob_90d, 50e0 AS flare_score, 50e0 AS priority_index,
'P3 - MEDIUM' AS priority_tier, false AS is_safe FROM camp""")
def _(spark, sf):
    return scoring.score_neutral(tb.campaigns(spark, sf).select("campaign_id"))


