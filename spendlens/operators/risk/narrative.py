"""Texts that go with a score: headline and severity, diagnosis pills, goal advice and recommended actions.

Inputs are the numeric columns of a scored frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.columns import optional
from ...functions.numeric import filled, half_even, truthy
from .params import CURRENT, DRIVER_NAMES, RiskParams

# Headlines, pills and action texts shown to users.
HEADLINES = {
    "safe": "PERFORMING — ON TRACK",
    "no_spend": "NOT SPENDING — CHECK LIVE STATE",
    "idle": "NOT SPENDING — ZERO LEADS",
    "zero_leads": "ZERO LEADS — NO CONVERSIONS",
    "crisis": "CPL CRISIS — NEW ACCOUNT — LOW LEADS",
    "high_cpl": "HIGH CPL — $%d vs $%d GOAL",
    "new": "NEW ACCOUNT AT RISK",
    "behind": "UNDERPACING — %d%% BEHIND",
    "on_goal": "PERFORMING — ON/UNDER GOAL",
    "bad_goal": "GOAL MISALIGNED — Reset Required",
    "quiet": "MONITORING FOR CHANGES",
}
ACTIONS = {
    "product": ("Add a second product (e.g., SEO or Website)", "Start Proposal →"),
    "leads": ("Fix tracking & lead quality audit", "Open Checklist →"),
    "cpl": ("Budget/keyword optimization for lead volume", "Open Planner →"),
    "tenure": ("Set expectations / launch plan call", "Schedule Call →"),
}
EARLY_DRIVERS = ("Early Account (≤90d)", "Early Tenure (≤3m)")
ZERO_LEAD_DRIVER = "Zero Leads (30d)"
CPL_DRIVER_WORDS = ("High CPL", "Elevated CPL", "CPL above goal")


def attach_headline(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """``headline_diagnosis`` and ``headline_severity``: the first rule that applies wins."""
    # Unknown inputs stay NULL: a rule that compares one simply does not apply.
    days, spent, io = F.col("days_elapsed"), F.col("amount_spent"), F.col("io_cycle")
    leads = F.floor(filled("running_cid_leads", 0.0))
    variance = F.col("cpl_variance_pct")
    plan, plan_spend = F.col("expected_leads_to_date"), optional(df, "expected_leads_to_date_spend")
    budget = F.col("campaign_budget")
    cpc = F.col("bsc_cpc_average")
    cpc = F.when(cpc == 0, 3.0).otherwise(cpc)
    cycle = F.col("avg_cycle_length") if "avg_cycle_length" in df.columns else F.lit(params.average_cycle)
    cycle = F.when(cycle == 0, params.average_cycle).otherwise(cycle)
    clicks = F.when(cpc > 0, budget / cycle / cpc).otherwise(0.0)
    viable = (
        (budget >= params.viable_budget)
        | (clicks >= params.viable_daily_clicks)
        | (F.col("expected_leads_monthly") >= params.viable_monthly_leads)
    )
    acute = (
        (leads == 0)
        & (days >= params.alert_days)
        & (days < 30)
        & viable
        & (plan >= params.alert_expected)
        & (spent >= params.alert_spend)
    )
    util = filled("utilization", 0.0)
    goal = F.coalesce(F.nullif(filled("effective_cpl_goal", 0.0), F.lit(0.0)), filled("cpl_goal", 0.0))
    shown_goal = F.floor(goal).cast("int")
    shown_cpl = F.floor(filled("running_cid_cpl", 0.0)).cast("int")
    behind_pct = F.floor((1 - util) * 100).cast("int")
    median, raw_goal = filled("bsc_cpl_avg", 0.0), filled("cpl_goal", 0.0)
    absurd = (median > 0) & (raw_goal > 0) & (F.col("goal_quality") == "too_low") & (raw_goal < 0.5 * median)
    h = HEADLINES
    rules = [
        (truthy("is_safe"), F.lit(h["safe"]), F.lit("healthy")),
        ((days >= params.alert_days) & (spent < params.alert_spend), F.lit(h["no_spend"]), F.lit("warning")),
        (truthy("zero_lead_idle"), F.lit(h["idle"]), F.lit("warning")),
        (truthy("zero_lead_last_mo") | truthy("zero_lead_emerging"), F.lit(h["zero_leads"]), F.lit("critical")),
        (acute, F.lit(h["zero_leads"]), F.lit("critical")),
        ((variance > 300) & (io <= 3) & (leads <= 5), F.lit(h["crisis"]), F.lit("critical")),
        (
            variance > 100,
            F.format_string(h["high_cpl"], shown_cpl, shown_goal),
            F.when(variance <= 200, "warning").otherwise("critical"),
        ),
        (io <= 3, F.lit(h["new"]), F.lit("warning")),
        ((util != 0) & (util < 0.5), F.format_string(h["behind"], behind_pct), F.lit("warning")),
        ((variance < -20) | ((plan_spend != 0) & (leads >= plan_spend)), F.lit(h["on_goal"]), F.lit("healthy")),
        (absurd, F.lit(h["bad_goal"]), F.lit("warning")),
    ]
    text, severity = None, None
    for test, headline, level in rules:
        text = F.when(test, headline) if text is None else text.when(test, headline)
        severity = F.when(test, level) if severity is None else severity.when(test, level)
    return df.withColumns(
        {"headline_diagnosis": text.otherwise(h["quiet"]), "headline_severity": severity.otherwise("neutral")}
    )


def _pill(test: Column, text, kind) -> Column:
    text = text if isinstance(text, Column) else F.lit(text)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.when(test, F.struct(text.alias("text"), kind.alias("type")))


def attach_pills(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """``diagnosis_pills``: ordered array of (text, type). A safe campaign has the single pill Performing."""
    leads, days = F.floor(filled("running_cid_leads", 0.0)), F.col("days_elapsed")
    months = F.col("true_months_running") if "true_months_running" in df.columns else F.lit(0.0)
    variance, util = F.col("cpl_variance_pct"), F.col("utilization")
    percent = F.when(variance < 0, F.ceil(variance)).otherwise(F.floor(variance)).cast("int")
    alert = truthy("zero_lead_last_mo") | truthy("zero_lead_emerging")
    idle = truthy("zero_lead_idle")
    waiting = (days >= params.alert_days) & (leads == 0) & truthy("_sem_viable")
    money = filled("revenue_at_risk", 0.0)
    quality = F.col("goal_quality")
    single = truthy(optional(df, "single_product_flag", "boolean")) | F.coalesce(
        optional(df, "true_product_count") == 1, F.lit(False)
    )
    pills = F.array_compact(
        F.array(
            F.coalesce(
                _pill(alert, "Zero Leads", "critical"),
                _pill(idle, "Zero Leads (Idle)", "warning"),
                _pill(waiting, "No Leads Yet", "warning"),
            ),
            _pill(
                F.abs(variance) > 20,
                F.format_string("CPL %s%d%%", F.when(percent > 0, "+").otherwise(""), percent),
                F.when(percent > 200, "critical").otherwise("warning"),
            ),
            _pill(months <= 3.0, "Early Account", "warning"),
            _pill(single, "Single Product", "neutral"),
            _pill(util < 0.5, F.format_string("Pacing -%d%%", F.floor((1 - util) * 100).cast("int")), "warning"),
            _pill(util > 1.25, F.format_string("Pacing +%d%%", F.floor((util - 1) * 100).cast("int")), "warning"),
            _pill(quality == "missing", "No Goal", "warning"),
            _pill(quality == "too_low", "Goal Too Low", "warning"),
            F.coalesce(_pill(money >= 5000, "High $ Risk", "critical"), _pill(money >= 2000, "$ Risk", "warning")),
        )
    )
    safe = F.array(F.struct(F.lit("Performing").alias("text"), F.lit("success").alias("type")))
    return df.withColumn("diagnosis_pills", F.when(truthy("is_safe"), safe).otherwise(pills))


def _band(r: Column) -> Column:
    return (
        F.when(r.isNull() | (r <= 0), "—")
        .when(r >= 3.0, "CRISIS (≥3×)")
        .when(r >= 2.0, "Major gap (2–3×)")
        .when(r >= 1.5, "Gap (1.5–2×)")
        .when(r > 1.1, "Slightly high (1.1–1.5×)")
        .when(r >= 0.9, "On target (±10%)")
        .otherwise("Under target (<0.9×)")
    )


def attach_goal_advice(df: DataFrame) -> DataFrame:
    """``goal_advice``: how realistic the goal is against the benchmark, and what to recommend instead."""
    positive = lambda c: F.when(c > 0, c)
    goal, effective = positive(F.col("cpl_goal")), positive(F.col("effective_cpl_goal"))
    actual = F.col("running_cid_cpl")
    p50 = F.coalesce(positive(F.col("bsc_cpl_avg")), F.lit(150.0))
    p25 = F.coalesce(positive(optional(df, "bsc_cpl_top_25pct")), p50 * 0.8)
    p75 = F.coalesce(positive(optional(df, "bsc_cpl_bottom_25pct")), p50 * 1.2)
    share = goal / p50
    status = (
        F.when(goal.isNull(), "missing")
        .when(share < 0.5, "too_low")
        .when(share < 0.7, "ambitious")
        .when(share <= 1.5, "reasonable")
        .when(share <= 2.5, "too_high")
        .otherwise("wildly_high")
    )
    low, high = F.greatest(p50 * 0.8, p25), F.least(p50 * 1.2, p75)
    point = F.least(F.greatest(p50, low), high)
    old_enough = (filled("days_elapsed", 0.0) >= 7) | (filled("io_cycle", 0.0) >= 1)
    dollars = lambda c: half_even(c).cast("int")
    advice = F.struct(
        (old_enough & status.isin("missing", "too_low")).alias("show"),
        status.alias("status"),
        goal.alias("goal_advertiser"),
        effective.alias("goal_effective"),
        truthy(optional(df, "goal_was_substituted", "boolean")).alias("goal_was_substituted"),
        F.struct(p25.alias("p25"), p50.alias("p50"), p75.alias("p75")).alias("benchmark"),
        F.struct(point.alias("point"), F.array(low, high).alias("range")).alias("recommended"),
        F.struct(
            F.when(goal.isNotNull(), _band(actual / goal)).otherwise("—").alias("vs_goal"),
            _band(F.try_divide(actual, point)).alias("vs_recommended"),
        ).alias("performance_band"),
        F.format_string(
            "Vertical median (p50) ≈ $%d. Recommended window $%d–$%d.", dollars(p50), dollars(low), dollars(high)
        ).alias("rationale"),
    )
    return df.withColumn("goal_advice", advice)


def attach_actions(df: DataFrame, top: int = 3, zero_lead_names: tuple[str, ...] = (ZERO_LEAD_DRIVER, DRIVER_NAMES["zero_month"])) -> DataFrame:
    """``actions``: up to ``top`` recommendations from ``risk_drivers``, biggest impact first.

    Impacts are points cut to whole numbers. Ties keep the order product, leads, CPL, tenure. The stored
    drivers spell the zero-lead name differently from what the action table expects, so both spellings match.
    """
    drivers = F.col("risk_drivers.drivers")

    def impact(match) -> Column:
        hit = F.get(F.filter(drivers, match), 0)
        return F.coalesce(hit["points"].cast("int"), F.lit(0))

    def named(*names):
        return lambda d: d["name"].isin(*names)

    def cpl_word(d):
        test = F.lit(False)
        for word in CPL_DRIVER_WORDS:
            test = test | d["name"].contains(word)
        return test & (d["points"].cast("int") > 0)

    impacts = {
        "product": impact(named(DRIVER_NAMES["single_product"])),
        "leads": impact(named(*zero_lead_names)),
        "cpl": impact(cpl_word),
        "tenure": F.greatest(*[impact(named(n)) for n in EARLY_DRIVERS]),
    }
    rows = [
        F.when(
            value > 0,
            F.struct(
                (-value).alias("order"),
                F.lit(i).alias("seq"),
                F.lit(ACTIONS[key][0]).alias("title"),
                value.alias("impact"),
                F.lit(ACTIONS[key][1]).alias("cta"),
            ),
        )
        for i, (key, value) in enumerate(impacts.items())
    ]
    ranked = F.slice(F.array_sort(F.array_compact(F.array(*rows))), 1, top)
    return df.withColumn(
        "actions",
        F.transform(
            ranked, lambda a: F.struct(a["title"].alias("title"), a["impact"].alias("impact"), a["cta"].alias("cta"))
        ),
    )
