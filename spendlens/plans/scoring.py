"""The scoring pipeline: repaired inputs, goals, churn, priority, tier, texts and explanation, as one lazy chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import number
from ..operators import tables
from ..operators.risk import churn, goals, narrative, priority, waterfall
from ..operators.risk.params import CURRENT, LEGACY, RiskParams

# Scores given to a campaign the model could not judge.
NEUTRAL = {"churn_prob_90d": 0.15, "flare_score": 50.0, "priority_index": 50.0, "priority_tier": "P3 - MEDIUM", "is_safe": False}


def score_risk(campaigns: DataFrame, params: RiskParams = CURRENT) -> DataFrame:
    """Everything that needs only the campaign's own row: no shuffle, no Python worker.

    To filter on a result column, pass the columns you need through ``functions.columns.fence`` first.
    """
    prepared = goals.set_goals(goals.prepare_campaigns(campaigns, params))
    return priority.priority_index(churn.score_churn(prepared, params), params)


def score_book(campaigns: DataFrame, ids: Sequence[str] = ("campaign_id",), params: RiskParams = CURRENT) -> DataFrame:
    """Full scores with texts and explanation. The percentile score is the only step that shuffles.

    The priority tier is always computed.
    """
    scored = priority.priority_score(score_risk(campaigns, params), ids, params)
    scored = priority.priority_tier(scored, params)
    scored = narrative.attach_pills(narrative.attach_headline(scored, params), params)
    return churn.attach_drivers(scored, params)


def score_legacy(campaigns: DataFrame, params: RiskParams = LEGACY) -> DataFrame:
    """Earlier scorer with drivers, for campaigns that carry their own flags and expectations."""
    return churn.attach_drivers(churn.score_churn_legacy(campaigns, params), params)


def score_legacy_ranked(campaigns: DataFrame, ids: Sequence[str] = ("campaign_id",)) -> tuple[DataFrame, DataFrame]:
    """Scored and ranked campaigns, and the rows rejected because they have no id or an unreadable amount."""
    ok = F.col("campaign_id").isNotNull() & number("campaign_budget").isNotNull()
    good = score_legacy(campaigns.where(ok))
    ranked = priority.priority_tier(priority.priority_score(priority.priority_index(good), ids))
    rejected = campaigns.where(~ok).withColumn(
        "reject_reason", F.when(F.col("campaign_id").isNull(), "missing campaign_id").otherwise("unreadable budget")
    )
    return ranked, rejected


def upsert_book(book: DataFrame | None, scored: DataFrame, ids: Sequence[str], scored_at: str = "scored_at") -> DataFrame:
    """The stored book with newly scored campaigns in it: rows of one key are replaced, of several new ones the last scored
    stays, campaigns that were not scored now keep their row. Columns that only one side has are NULL on the other."""
    return tables.upsert(scored.limit(0) if book is None else book, scored, list(ids), [scored_at])


def score_neutral(campaigns: DataFrame) -> DataFrame:
    """Neutral scores for campaigns without model inputs."""
    return campaigns.withColumns({n: F.lit(v) for n, v in NEUTRAL.items()})


def explain_book(scored: DataFrame) -> DataFrame:
    """Actions and waterfall on top of a scored book."""
    return waterfall.bar_geometry(waterfall.waterfall_of_scores(narrative.attach_actions(scored)))
