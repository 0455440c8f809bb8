"""Additive scorer for books without model inputs, and the campaign rows built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.columns import optional
from ...functions.numeric import number
from .params import DRIVER_NAMES

# Risk added per condition and its displayed impact; tiers by lower bound.
BASE_RISK, LOWEST, HIGHEST = 0.08, 0.02, 0.45
RULES = {
    "cpl_high": (0.15, DRIVER_NAMES["cpl_high"], 25),
    "cpl_elevated": (0.08, "Elevated CPL", 12),
    "cpl_good": (-0.05, "Good CPL Performance (protective)", -8),
    "no_leads": (0.20, "Zero Leads (30d)", 30),
    "few_leads": (0.10, "Lead deficit (≤50% plan)", 15),
    "many_leads": (-0.06, "Good Lead Volume (protective)", -10),
    "underpacing": (0.05, "Underpacing", 8),
    "first_month": (0.12, "Early Account (≤30d)", 18),
    "first_quarter": (0.06, "New Account (≤3m)", 10),
}
TIERS = ((0.30, "P1 - CRITICAL"), (0.20, "P2 - HIGH"), (0.10, "P3 - MEDIUM"))
LOWEST_TIER = "P4 - LOW"


def _conditions(df: DataFrame) -> list[dict[str, Column]]:
    """Rule groups in the order they are added; inside a group the first match counts."""
    cpl, goal = number("cost_per_lead"), number(optional(df, "cpl_goal"), 100.0)
    ratio = F.when((cpl != 0) & (goal > 0), F.try_divide(cpl, goal)).otherwise(1.0)
    leads = F.floor(number("total_leads", 0.0))
    expected = F.coalesce(F.floor(number(optional(df, "expected_leads"))), F.floor(leads * 1.2))
    util, months = number(optional(df, "utilization"), 100.0) / 100, number(optional(df, "months_running"), 6.0)
    return [
        {"cpl_high": ratio >= 3.0, "cpl_elevated": ratio >= 1.5, "cpl_good": ratio <= 0.8},
        {"no_leads": leads == 0, "few_leads": leads < expected * 0.5, "many_leads": leads >= expected},
        {"underpacing": (util != 0) & (util < 0.7)},
        {"first_month": (months != 0) & (months <= 1), "first_quarter": (months != 0) & (months <= 3)},
    ]


def score_heuristic(df: DataFrame, noise_seed: int | None = None) -> DataFrame:
    """Churn, drivers, tier and score by rule. Noise of ±10 on the score is added only for a given seed."""
    risk, drivers = F.lit(BASE_RISK), []
    for group in _conditions(df):
        added, entry = None, None
        for key, test in group.items():
            delta, name, impact = RULES[key]
            driver = F.struct(F.lit(name).alias("name"), F.lit(impact).alias("impact"))
            added = F.when(test, delta) if added is None else added.when(test, delta)
            entry = F.when(test, driver) if entry is None else entry.when(test, driver)
        risk = risk + added.otherwise(0.0)
        drivers.append(entry)
    df = df.withColumns(
        {"churn_prob": F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), risk)), "_drivers": F.array_compact(F.array(*drivers))}
    )
    p, tier = F.col("churn_prob"), None
    for bound, label in TIERS:
        tier = F.when(p >= bound, label) if tier is None else tier.when(p >= bound, label)
    score = p * 200
    if noise_seed is not None:
        score = score + (F.rand(noise_seed) * 20 - 10)
    return df.withColumns(
        {
            "risk_drivers": F.struct(F.floor(p * 100 * 0.6).cast("int").alias("baseline"), F.col("_drivers").alias("drivers")),
            "priority_tier": tier.otherwise(LOWEST_TIER),
            "flare_score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)),
        }
    ).drop("_drivers")


def build_campaigns(scored: DataFrame) -> DataFrame:
    """Book columns of a heuristically scored campaign."""
    p, score, months = F.col("churn_prob"), F.col("flare_score"), number(optional(scored, "months_running"), 3.0)
    days = F.floor(months * 30).cast("int")
    util = number(optional(scored, "utilization"), 0.8)
    return scored.withColumns(
        {
            "days_elapsed": days,
            "true_days_running": days,
            "utilization": F.least(F.lit(999.99), F.greatest(F.lit(0.0), util * 100)),
            "cpl_goal": number("cost_per_lead", 100.0) * 0.8,
            "expected_leads_to_date": F.floor(number("total_leads", 0.0) * 1.1).cast("int"),
            "cycle_label": F.format_string("Month %d", F.floor(months).cast("int")),
            "priority_index": score * 10,
            "primary_issue": F.when(p > 0.25, "Lead Volume").otherwise("CPL Performance"),
            "churn_risk_band": F.when(p > 0.25, "High").when(p > 0.15, "Medium").otherwise("Low"),
            "revenue_at_risk": number("campaign_budget", 0.0) * p,
            "flare_band": F.when(score > 70, "Red").when(score > 40, "Yellow").otherwise("Green"),
            "headline_diagnosis": F.concat(
                F.lit("Campaign performance requires attention on "), F.lower("priority_tier")
            ),
            "headline_severity": F.when(p > 0.25, "High").otherwise("Medium"),
            "campaign_count": F.lit(1),
            "is_safe": p < 0.10,
            "status": F.lit("new"),
        }
    )
