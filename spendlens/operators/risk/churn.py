"""90-day churn: odds of a tenure baseline multiplied by up to five factors, and what each factor adds.

The factors are scalar columns (``f_*``, NULL when absent), so the probability runs in generated code. The driver
array is only assembled from them when a query asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.columns import optional, with_missing
from ...functions.numeric import bounded, filled, half_even, number, right_closed, truthy
from .params import CURRENT, DRIVER_NAMES, RiskParams

# Band and tenure labels.
CHURN_BANDS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
TENURES = ("LTE_90D", "M3_6", "GT_6")

# Order in which factors multiply the odds, and whether the account team controls them.
FACTORS = (
    ("f_cpl", True),
    ("f_deficit", True),
    ("f_zero_emerging", True),
    ("f_zero_month", True),
    ("f_single", False),
)

LEGACY_INPUTS = (
    "running_cid_cpl", "effective_cpl_goal", "cpl_ratio", "io_cycle", "days_elapsed", "expected_leads_to_date",
    "running_cid_leads", "spend_progress", "campaign_budget", "advertiser_product_count",
)

CHURN_INPUTS = {
    n: "double"
    for n in (
        "io_cycle", "advertiser_product_count", "running_cid_leads", "days_elapsed", "running_cid_cpl",
        "effective_cpl_goal", "campaign_budget", "amount_spent", "utilization", "cpl_goal", "bsc_cpc_average",
        "bsc_cpl_avg", "leads_rolling_30d",
    )
}


def cpl_hazard(cpl_ratio, params: RiskParams = CURRENT) -> Column:
    """Hazard of a CPL ratio: smooth and capped above 1, or the step table when the curve is switched off."""
    r = F.col(cpl_ratio) if isinstance(cpl_ratio, str) else cpl_ratio
    if params.smooth_cpl:
        excess = r - 1.0
        return F.when(r <= 1.0, 1.0).otherwise(F.least(1.0 + params.cpl_alpha * (excess * excess), F.lit(params.cpl_cap)))
    step = None
    for bound, hazard in params.cpl_steps:
        value = F.lit(max(0.5, hazard))
        step = F.when(r <= bound, value) if step is None else step.when(r <= bound, value)
    return step.otherwise(1.0)


def tenure_bucket(months) -> Column:
    return F.when(months <= 3.0, TENURES[0]).when(months <= 6.0, TENURES[1]).otherwise(TENURES[2])


def _plan_known(df: DataFrame, given_cycle: Column) -> Column:
    """Whether a campaign states enough for a lead deficit to be charged; gaps elsewhere are filled, here not."""
    goal = F.col("effective_cpl_goal")
    known = goal.isNotNull() & ((goal > 0) | F.col("bsc_cpl_avg").isNotNull())
    for name in ("days_elapsed", "campaign_budget", "amount_spent"):
        known = known & F.col(name).isNotNull()
    return known & given_cycle.isNotNull() if "avg_cycle_length" in df.columns else known


def plan_and_pacing(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """Planned leads, pacing, viability and tenure: the ``_``-columns every later step reads."""
    df = with_missing(df, CHURN_INPUTS)
    given_cycle = optional(df, "avg_cycle_length")
    cycle = F.coalesce(F.nullif(given_cycle, F.lit(0.0)), F.lit(params.average_cycle))
    goal = F.coalesce(F.nullif(filled("effective_cpl_goal", 0.0), F.lit(0.0)), filled("bsc_cpl_avg", 150.0))
    df = df.withColumns(
        {
            "_days": filled("days_elapsed", 0.0),
            "_leads": filled("running_cid_leads", 0.0),
            "_spend": filled("amount_spent", 0.0),
            "_budget": filled("campaign_budget", 0.0),
            "_cycle": cycle,
            "_plan_goal": goal,
            "_io": filled("io_cycle", 0.0),
            "_plan_known": _plan_known(df, given_cycle),
        }
    )
    budget, days = F.col("_budget"), F.col("_days")
    df = df.withColumns(
        {
            "_month_plan": bounded(budget / F.greatest("_plan_goal", F.lit(1.0)), 0.0, 999.0),
            "_progress": F.least(days / F.col("_cycle"), F.lit(1.0)),
        }
    )
    plan_to_date = bounded(F.col("_month_plan") * F.col("_progress"), 0.1, 999.0)
    ideal_spend = F.greatest(budget, F.lit(10.0)) * F.col("_progress")
    daily_clicks = filled(F.try_divide(budget / F.col("_cycle"), filled("bsc_cpc_average", 3.0)), 0.0)
    tenure_days = F.greatest(F.col("_io") - 1, F.lit(0.0)) * F.col("_cycle") + days
    return df.withColumns(
        {
            "_plan_td": plan_to_date,
            "_deficit_plan": F.greatest(
                F.greatest(budget / F.greatest("_plan_goal", F.lit(1.0)), F.lit(0.0)) * F.col("_progress"), F.lit(0.1)
            ),
            "_lead_ratio": bounded(F.col("_leads") / F.greatest(plan_to_date, F.lit(0.1)), 0.0, 10.0),
            "spend_progress": bounded(F.col("_spend") / F.greatest(ideal_spend, F.lit(1.0)), 0.0, 2.0),
            "cpl_ratio": filled(F.try_divide(filled("running_cid_cpl", 0.0), F.col("effective_cpl_goal")), 1.0),
            "_viab_budget_ok": budget >= params.viable_budget,
            "_viab_clicks_ok": daily_clicks >= params.viable_daily_clicks,
            "_viab_volume_ok": F.col("_month_plan") >= params.viable_monthly_leads,
            "_tenure": tenure_bucket(half_even(tenure_days / 30.0, 1)),
            "expected_leads_monthly": F.col("_month_plan"),
            "expected_leads_to_date": plan_to_date,
        }
    ).withColumn("_sem_viable", F.col("_viab_budget_ok") | F.col("_viab_clicks_ok") | F.col("_viab_volume_ok"))


def zero_lead_flags(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """No leads for a month, emerging within a month, or idle for lack of spend."""
    none, days, spend = F.col("_leads") == 0, F.col("_days"), F.col("_spend")
    month = (
        none
        & (days >= 30)
        & (spend >= params.alert_spend)
        & (F.col("spend_progress") >= params.month_progress)
        & F.col("_sem_viable")
    )
    if params.strict_rolling_gate:
        month = month & F.coalesce(F.col("leads_rolling_30d") == 0, F.lit(False))
    emerging = (
        none
        & (days >= params.alert_days)
        & (days < 30)
        & (spend >= params.alert_spend)
        & (F.col("_plan_td") >= params.alert_expected)
        & (F.col("spend_progress") >= params.alert_progress)
        & F.col("_sem_viable")
    )
    idle = none & (days >= params.alert_days) & (spend < params.alert_spend)
    return df.withColumns({"zero_lead_last_mo": month, "zero_lead_emerging": emerging, "zero_lead_idle": idle})


def safe_rule(df: DataFrame) -> Column:
    """Six ways to be clearly performing, all closed to campaigns with a zero-lead alert.

    A missing CPL counts as 999 here and so never looks efficient.
    """
    cpl, bench = filled("running_cid_cpl", 999.0), filled("bsc_cpl_avg", 150.0)
    goal = filled("cpl_goal", 0.0)
    operating = F.coalesce("effective_cpl_goal", goal)
    days, leads, spend, plan_share = F.col("_days"), F.col("_leads"), F.col("_spend"), F.col("_lead_ratio")
    young = days < 30
    ways = (
        days.between(2, 7) & (spend >= 500) & (leads >= 3) & (cpl <= bench * 2.0),
        (cpl <= operating * 1.1) & (plan_share >= 0.8) & (days >= 10) & (leads >= 3),
        (cpl <= bench * 0.5) & (leads >= 10),
        young & (days >= 5) & ((plan_share >= 0.6) | (leads >= 1)) & (cpl <= bench * 0.8) & (spend >= 300),
        young & (days >= 3) & (leads >= 1) & (cpl <= bench * 0.7) & (spend >= 100),
        (goal > 0) & (cpl <= goal * 0.8) & (leads >= 1),
    )
    any_way = ways[0]
    for way in ways[1:]:
        any_way = any_way | way
    return any_way & ~F.col("zero_lead_last_mo") & ~F.col("zero_lead_emerging")


def odds_factors(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """The five factor columns, NULL where a factor does not apply."""
    r = F.col("cpl_ratio")
    hazard = cpl_hazard(r, params)
    # The deficit compares with the full plan; only the published plan stops at 999 leads.
    share = F.try_divide(F.col("_leads"), F.col("_deficit_plan"))
    deep = (share <= 0.25) & (F.col("spend_progress") >= 0.5) & (F.col("_days") >= 7)
    mild = (share <= 0.50) & (F.col("spend_progress") >= 0.4) & (F.col("_days") >= 5)
    planned = (F.col("_deficit_plan") >= 1) & F.col("_plan_known") & F.col("_sem_viable")
    return df.withColumns(
        {
            "f_cpl": F.when((r >= 1.2) & (hazard > 1.0), hazard),
            "f_deficit": F.when(planned & deep, params.severe_deficit).when(planned & mild, params.moderate_deficit),
            "f_zero_emerging": F.when(F.col("zero_lead_emerging"), params.zero_emerging),
            "f_zero_month": F.when(F.col("zero_lead_last_mo"), params.zero_month),
            "f_single": F.when(F.col("_products") == 1, params.single_product),
        }
    )


def stack_odds(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """Baseline, probability before and after the safe clamp, band and money at risk."""
    early, middle, late = params.baselines
    base = F.when(F.col("_tenure") == TENURES[0], early).when(F.col("_tenure") == TENURES[1], middle).otherwise(late)
    df = df.withColumn("baseline_p", base)
    odds = F.col("baseline_p") / (1.0 - F.col("baseline_p"))
    for name, _ in FACTORS:
        odds = odds * F.coalesce(name, F.lit(1.0))
    raw = F.col("churn_prob_90d_unclamped")
    return (
        df.withColumn("_odds", odds)
        .withColumn("churn_prob_90d_unclamped", F.col("_odds") / (1.0 + F.col("_odds")))
        .withColumn("churn_prob_90d", F.when(F.col("is_safe"), F.least(raw, F.col("baseline_p"))).otherwise(raw))
        .withColumns(
            {
                "revenue_at_risk": F.col("_budget") * F.col("churn_prob_90d"),
                "churn_risk_band": right_closed("churn_prob_90d", params.churn_bands, CHURN_BANDS, CHURN_BANDS[0]),
                "risk_model_version": F.lit(params.model_version),
            }
        )
    )


def driver_names() -> dict[str, Column]:
    """Display name of each factor column."""
    n = DRIVER_NAMES
    r = F.col("cpl_ratio")
    return {
        "f_cpl": F.when(r >= 3.0, n["cpl_high"]).when(r >= 1.5, n["cpl_elevated"]).otherwise(n["cpl_above"]),
        "f_deficit": F.when(F.col("f_deficit") > 2.0, n["deficit_severe"]).otherwise(n["deficit_moderate"]),
        "f_zero_emerging": F.lit(n["zero_emerging"]),
        "f_zero_month": F.lit(n["zero_month"]),
        "f_single": F.lit(n["single_product"]),
    }


def driver_points() -> dict[str, Column]:
    """Percentage points each present factor adds on top of the ones before it, to one decimal."""
    odds = F.col("baseline_p") / (1.0 - F.col("baseline_p"))
    points = {}
    for name, _ in FACTORS:
        after = odds * F.coalesce(name, F.lit(1.0))
        step = (after / (1.0 + after) - odds / (1.0 + odds)) * 100.0
        points[name] = F.when(F.col(name).isNotNull(), half_even(step, 1))
        odds = after
    return points


def attach_drivers(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """``risk_drivers``: the stored explanation of a score, and ``reconcile_ok``.

    Points are rounded one by one, so their sum may miss the rounded probability. More than one point of
    difference clears ``reconcile_ok``; it does not stop the batch.
    """
    names, points = driver_names(), driver_points()
    df = df.withColumns({f"_pp{name}": c for name, c in points.items()})
    entries, total = [], F.lit(0.0)
    for name, controllable in FACTORS:
        lift, pp = F.col(name), F.col(f"_pp{name}")
        entries.append(
            F.when(
                lift.isNotNull(),
                F.struct(
                    names[name].alias("name"),
                    pp.alias("points"),
                    F.lit(controllable).alias("is_controllable"),
                    F.format_string("Factor multiplier: %.2fx", lift).alias("explanation"),
                    lift.alias("lift_x"),
                ),
            )
        )
        total = total + F.coalesce(half_even(pp), F.lit(0.0))
    raw_pct = half_even(F.col("churn_prob_90d_unclamped") * 100)
    base_pct = half_even(F.col("baseline_p") * 100)
    payload = F.struct(
        base_pct.cast("int").alias("baseline"),
        F.array_compact(F.array(*entries)).alias("drivers"),
        raw_pct.cast("int").alias("p_unclamped_pct"),
        half_even(F.col("churn_prob_90d") * 100).cast("int").alias("p_clamped_pct"),
        F.col("is_safe").alias("is_safe"),
        (F.col("is_safe") & (F.col("churn_prob_90d_unclamped") > F.col("churn_prob_90d") + 0.01)).alias("safe_clamped"),
        F.lit(params.model_version).alias("model_version"),
        F.struct(
            F.lit(params.single_product).alias("single_product_hr"),
            F.lit(params.cpl_alpha).alias("cpl_hr_alpha"),
            F.lit(params.cpl_cap).alias("cpl_hr_cap"),
            F.lit(params.smooth_cpl).alias("use_smooth_curve"),
        ).alias("constants_used"),
    )
    return df.withColumns({"risk_drivers": payload, "reconcile_ok": F.abs(base_pct + total - raw_pct) <= 1}).drop(
        *[f"_pp{n}" for n, _ in FACTORS]
    )


def rescaled_points(df: DataFrame, total_pct, out: str = "rescaled_drivers") -> DataFrame:
    """Scale driver points in proportion so that they and the baseline meet ``total_pct``."""
    drivers = F.col("risk_drivers.drivers")
    base = F.col("baseline_p") * 100
    have = F.aggregate(drivers, F.lit(0.0), lambda acc, d: acc + d["points"])
    want = (F.col(total_pct) if isinstance(total_pct, str) else total_pct) * 100
    factor = F.when((F.abs(base + have - want) > 0.1) & (have != 0), (want - base) / have)
    return df.withColumn(
        out,
        F.when(
            factor.isNotNull(),
            F.transform(drivers, lambda d: d.withField("points", half_even(d["points"] * factor, 1))),
        ).otherwise(drivers),
    )


def score_churn(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """Current generation: everything from plan to money at risk. Expects the columns of ``set_goals``."""
    df = plan_and_pacing(df, params).withColumn("_products", F.col("advertiser_product_count"))
    df = zero_lead_flags(df, params)
    df = df.withColumn("is_safe", safe_rule(df))
    return stack_odds(odds_factors(df, params), params)


def score_churn_legacy(df: DataFrame, params: RiskParams) -> DataFrame:
    """Earlier generation: flags, pacing and expected leads are taken from the input, absent ones are off."""
    df = with_missing(df, {"io_cycle": "double", "days_elapsed": "double", "running_cid_cpl": "double"})
    df = df.withColumns({n: number(n) for n in LEGACY_INPUTS if n in df.columns})
    flags = {n: truthy(optional(df, n, "boolean")) for n in (
        "is_safe", "zero_lead_emerging", "zero_lead_last_mo", "_sem_viable")}
    cpl, goal = filled("running_cid_cpl", 0.0), filled("effective_cpl_goal", 0.0)
    given = filled(optional(df, "cpl_ratio"), 1.0)
    months = (filled("io_cycle", 1.0) - 1) * params.average_cycle + filled("days_elapsed", 0.0)
    expected = filled(optional(df, "expected_leads_to_date"), 0.0)
    leads = F.floor(filled("running_cid_leads", 0.0))
    df = df.withColumns(
        flags
        | {
            "cpl_ratio": F.when((given == 1.0) & (goal > 0) & (cpl > 0), F.try_divide(cpl, goal)).otherwise(given),
            "spend_progress": filled(optional(df, "spend_progress"), 0.0),
            "_days": filled("days_elapsed", 0.0),
            "_budget": filled("campaign_budget", 0.0),
            "_leads": leads,
            "_deficit_plan": expected,
            "_plan_known": F.lit(True),
            "_products": filled(optional(df, "advertiser_product_count"), 1.0),
            "_tenure": tenure_bucket(months / 30.0),
        }
    )
    return stack_odds(odds_factors(df, params), params)
