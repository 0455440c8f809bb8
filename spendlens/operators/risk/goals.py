"""Input repair and the three-goal system: the goal shown, the goal operated on and the goal risk is judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.columns import optional, with_missing
from ...functions.numeric import clip, number, ratio
from .params import CURRENT, RiskParams

TEXT_INPUTS = ("am", "optimizer", "gm", "partner_name", "advertiser_name", "campaign_name", "bid_name")
NUMBER_INPUTS = (
    "io_cycle", "campaign_budget", "running_cid_leads", "utilization", "cpl_goal", "bsc_cpl_avg", "running_cid_cpl",
    "amount_spent", "days_elapsed", "bsc_cpc_average", "advertiser_product_count",
)


def prepare_campaigns(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """Add absent inputs as NULL, coerce numbers, and repair utilization.

    A utilization of 3 or more is a percentage. What then falls outside (0, 2] is replaced by spend over the
    ideal spend to date, bounded to [0, 2], or by 0 when that is unknown.
    """
    df = with_missing(df, {n: "string" for n in TEXT_INPUTS} | {n: "double" for n in NUMBER_INPUTS})
    df = df.withColumns({n: number(n) for n in NUMBER_INPUTS})
    share = F.when(F.col("utilization") >= 3, F.col("utilization") / 100).otherwise(F.col("utilization"))
    cycle_days = F.coalesce(
        F.nullif(F.col("io_cycle") * params.average_cycle, F.lit(0.0)), F.lit(params.average_cycle)
    )
    ideal = F.col("campaign_budget") / cycle_days * F.coalesce("days_elapsed", F.lit(0.0))
    spent_share = clip(F.try_divide("amount_spent", ideal), 0.0, 2.0)
    usable = (share > 0) & (share <= 2.0)
    return df.withColumns(
        {
            "is_cpl_goal_missing": F.col("cpl_goal").isNull() | (F.col("cpl_goal") == 0),
            "utilization": F.coalesce(F.when(usable, share).otherwise(spent_share), F.lit(0.0)),
            "age_risk": F.lit(0),
            "maturity_amplifier": F.lit(1.0),
        }
    )


def goal_quality(goal, median) -> Column:
    goal, median = F.col(goal), F.col(median)
    return (
        F.when(goal.isNull() | (goal == 0), "missing")
        .when(goal < median * 0.5, "too_low")
        .when(goal > median * 1.5, "too_high")
        .otherwise("reasonable")
    )


def issue_category(df: DataFrame) -> Column:
    """Main issue of a campaign. CPL variance and performance score only count when the input carries them."""
    variance = optional(df, "cpl_variance_pct")
    score = optional(df, "unified_performance_score")
    return (
        F.when((F.col("running_cid_leads") == 0) & (F.col("amount_spent") > 100), "CONVERSION_FAILURE")
        .when(variance > 200, "EFFICIENCY_CRISIS")
        .when(score >= 6, "PERFORMANCE_ISSUE")
        .when(F.col("maturity_amplifier") >= 1.8, "NEW_ACCOUNT")
        .when(F.col("utilization") < 0.5, "UNDERPACING")
        .when(variance < -20, "PERFORMING")
        .otherwise("MONITORING")
    )


def set_goals(df: DataFrame) -> DataFrame:
    """Effective and risk goals, whether the goal was substituted, and the distance of the CPL from it."""
    goal, median = F.col("cpl_goal"), F.col("bsc_cpl_avg")
    quality = F.col("goal_quality")
    substituted = quality.isin("missing", "too_low")
    # A missing benchmark leaves a reasonable goal without a risk goal, as clamping by an unknown median does.
    clamped = F.when(median.isNotNull(), F.least(F.greatest(goal, median * 0.8), median * 1.2))
    effective, cpl = F.col("effective_cpl_goal"), F.col("running_cid_cpl")
    return (
        df.withColumns({"issue_category": issue_category(df), "goal_quality": goal_quality("cpl_goal", "bsc_cpl_avg")})
        .withColumns(
            {
                "effective_cpl_goal": F.when(substituted, median).otherwise(goal),
                "risk_cpl_goal": F.when(quality.isin("missing", "too_low", "too_high"), median).otherwise(clamped),
                "goal_was_substituted": substituted,
            }
        )
        .withColumns(
            {
                "cpl_delta": cpl - effective,
                "cpl_variance_pct": F.when(effective > 0, (F.try_divide(cpl, effective) - 1) * 100).otherwise(0.0),
            }
        )
    )


def expected_leads(df: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """Leads a month of budget should buy: clicks at the benchmark CPC times the benchmark conversion rate,
    or budget over the risk goal where the CPC is unusable; and the same paced to date."""
    budget, days = number("campaign_budget", 0.0), number("days_elapsed", 0.0)
    target, bench = number("risk_cpl_goal", 150.0), number("bsc_cpl_avg", 150.0)
    cpc = number("bsc_cpc_average")
    rate = ratio(cpc, bench)
    rate = clip(F.when(rate > 0, rate).otherwise(params.conversion_prior), 0.01, 0.25)
    monthly = F.coalesce(ratio(budget, cpc) * rate, F.try_divide(budget, target))
    pacing = clip(days / params.average_cycle, 0.0, 2.0)
    return df.withColumns(
        {
            "expected_leads_monthly": clip(F.coalesce(monthly, F.lit(0.0)), 0.0, 1e6),
            "expected_leads_to_date": F.coalesce(monthly * pacing, F.lit(0.0)),
            "expected_leads_to_date_spend": F.when(
                target > 0, F.try_divide(number("amount_spent", 0.0), target)
            ).otherwise(0.0),
        }
    )
