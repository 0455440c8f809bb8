"""Parameters of the churn model, one instance per scorer generation."""

from __future__ import annotations

from dataclasses import dataclass, field

# Average lifetime value per business category.
CATEGORY_LTV = {
    "Attorneys & Legal Services": 149000,
    "Physicians & Surgeons": 99000,
    "Automotive -- For Sale": 98000,
    "Industrial & Commercial": 92000,
    "Home & Home Improvement": 88000,
    "Health & Fitness": 84000,
    "Career & Employment": 81000,
    "Finance & Insurance": 79000,
    "Business Services": 65000,
    "Real Estate": 62000,
    "Education & Instruction": 55000,
    "Sports & Recreation": 49000,
    "Automotive -- Repair, Service & Parts": 45000,
    "Travel": 39000,
    "Personal Services (Weddings, Cleaners, etc.)": 31000,
    "Computers, Telephony & Internet": 29000,
    "Farming & Agriculture": 25000,
    "Restaurants & Food": 12000,
    "Beauty & Personal Care": 11000,
    "Community/Garage Sales": 11000,
    "Animals & Pets": 10000,
    "Apparel / Fashion & Jewelry": 10000,
    "Arts & Entertainment": 9000,
    "Religion & Spirituality": 8000,
    "Government & Politics": 8000,
    "Toys & Hobbies": 8000,
    "z - Other (Specify Keywords Below)": 40000,
}

# Driver names as stored with a scored campaign.
DRIVER_NAMES = {
    "cpl_high": "High CPL (≥3× goal)",
    "cpl_elevated": "Elevated CPL (1.5–3×)",
    "cpl_above": "CPL above goal (1.2–1.5×)",
    "deficit_severe": "Severe lead deficit (≤25% of plan)",
    "deficit_moderate": "Moderate lead deficit (≤50% of plan)",
    "zero_emerging": "Zero leads (emerging)",
    "zero_month": "Zero leads (30+ days)",
    "single_product": "Single Product",
}


@dataclass(frozen=True)
class RiskParams:
    """Fixed values of the model; the defaults are the current generation."""

    model_version: str = "risk-2025-09-18-SCOPE-FIXED"
    # A month, in days, and the conversion rate assumed when CPC and CPL are unusable.
    average_cycle: float = 30.4
    conversion_prior: float = 0.06
    # Churn baseline per tenure: up to 3 months, 3 to 6 months, beyond.
    baselines: tuple[float, float, float] = (0.11, 0.08, 0.05)
    # CPL hazard: 1 + alpha * (ratio - 1)^2, capped; or the step table when the curve is off.
    smooth_cpl: bool = True
    cpl_alpha: float = 0.55
    cpl_cap: float = 1.8
    cpl_steps: tuple[tuple[float, float], ...] = ((1.2, 1.05), (1.5, 1.20), (3.0, 1.60), (999.0, 2.40))
    # Odds multipliers.
    severe_deficit: float = 2.8
    moderate_deficit: float = 1.6
    zero_emerging: float = 1.8
    zero_month: float = 2.5
    single_product: float = 1.35
    # Search viability: any of these is enough.
    viable_budget: float = 2500.0
    viable_daily_clicks: float = 3.0
    viable_monthly_leads: float = 3.0
    # Zero-lead alerts.
    alert_days: int = 5
    alert_spend: float = 250.0
    alert_expected: float = 1.0
    alert_progress: float = 0.5
    month_progress: float = 0.7
    # Compat: the 30-day lead count never closes the last-month gate. Strict: it must be known and zero.
    strict_rolling_gate: bool = False
    # Priority index exponents and the treatment of safe campaigns.
    revenue_power: float = 0.6
    churn_power: float = 0.4
    index_floor: float = 1e-12
    safe_index_share: float = 0.05
    safe_score_cap: float = 15.0
    score_bands: tuple[float, ...] = (0.0, 0.45, 0.65, 0.85, 1.01)
    churn_bands: tuple[float, ...] = (0.0, 0.15, 0.30, 0.45, 1.01)
    # Legacy scorer: tenure uses the average month, inputs are taken as supplied.
    legacy: bool = False
    tenure_edges: tuple[float, float] = field(default=(3.0, 6.0))


CURRENT = RiskParams()
LEGACY = RiskParams(model_version="legacy", baselines=(0.09, 0.06, 0.05), legacy=True)
