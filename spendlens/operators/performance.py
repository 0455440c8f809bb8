"""Campaign performance against benchmarks, partner pipeline health and the dashboards built on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, zero_as_null
from .joins import latest_only

# Tier and status names shown to users.
TIERS = ("excellent", "good", "average", "below_average")
CLOSED_STAGES = {"Closed Won": "won", "Closed Lost": "lost"}
TREND_METRICS = {
    "cpl": ("avg", "actual_cpl"),
    "cpc": ("avg", "actual_cpc"),
    "conversion_rate": ("avg", "conversion_rate"),
    "spend": ("sum", "actual_spend"),
}
TREND_PERIODS = ("day", "week", "month")


def performance_tier(cpl, top25, median, bot25) -> Column:
    """First bound the CPL does not exceed; an unknown CPL or bound never qualifies."""
    tier = F.when(cpl <= top25, TIERS[0])
    tier = tier.when(cpl <= median, TIERS[1])
    return tier.when(cpl <= bot25, TIERS[2]).otherwise(TIERS[3])


def campaign_performance(campaigns: DataFrame, benchmarks: DataFrame, latest_snapshot: bool = True) -> DataFrame:
    """Campaigns with leads, next to the benchmark of their product.

    With ``latest_snapshot=False`` a campaign appears once per benchmark snapshot that knows its product.
    """
    bench = latest_only(benchmarks, "snapshot_date") if latest_snapshot else benchmarks
    bench = bench.select(
        F.col("key").alias("_key"),
        F.col("cpl_top25"),
        F.col("cpl_bot25"),
        F.col("cpl_median").alias("benchmark_cpl_median"),
        F.col("cpc_median").alias("benchmark_cpc_median"),
    )
    live = campaigns.where(F.col("running_cid_leads") > 0)
    joined = live.join(bench, F.lower("product") == F.col("_key"), "left")
    cpl = F.col("running_cid_cpl")
    return joined.select(
        "campaign_id",
        "campaign_name",
        "advertiser_name",
        "channel",
        "product",
        F.col("amount_spent").alias("actual_spend"),
        F.col("campaign_budget").alias("budget"),
        F.col("running_cid_leads").alias("leads"),
        "clicks",
        cpl.alias("actual_cpl"),
        F.col("avg_cpc").alias("actual_cpc"),
        F.when(F.col("clicks") > 0, ratio("running_cid_leads", "clicks")).alias("conversion_rate"),
        "benchmark_cpl_median",
        "benchmark_cpc_median",
        performance_tier(cpl, F.col("cpl_top25"), F.col("benchmark_cpl_median"), F.col("cpl_bot25")).alias(
            "cpl_performance_tier"
        ),
        "snapshot_date",
        "extracted_at",
    )


def filter_performance(
    perf: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    channel: str | None = None,
    tier: str | None = None,
) -> DataFrame:
    """Optional conjunctive filters; each is pushed to the scan when it can be."""
    tests = [
        (start, F.col("snapshot_date") >= F.lit(start)),
        (end, F.col("snapshot_date") <= F.lit(end)),
        (channel, F.col("channel") == F.lit(channel)),
        (tier, F.col("cpl_performance_tier") == F.lit(tier)),
    ]
    for value, test in tests:
        if value is not None:
            perf = perf.where(test)
    return perf


def top_campaigns(perf: DataFrame, limit: int = 100) -> DataFrame:
    """Newest snapshot first, then the biggest spend; unknown spend last."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie between 1 and 1000")
    return perf.orderBy(
        F.desc_nulls_first("snapshot_date"), F.desc_nulls_last("actual_spend"), F.asc("campaign_id")
    ).limit(limit)


def _tier_counts(names: dict[str, str]) -> list[Column]:
    return [F.count_if(F.col("cpl_performance_tier") == t).alias(n) for t, n in names.items()]


def executive_dashboard(perf: DataFrame, as_of: dt.date | None = None, months: int = 12) -> DataFrame:
    """Monthly totals. ``as_of`` limits the input to the ``months`` before it; None keeps everything."""
    if as_of is not None:
        perf = perf.where(F.col("snapshot_date") >= F.add_months(F.lit(as_of), -months))
    return perf.groupBy(F.trunc("snapshot_date", "month").alias("month")).agg(
        F.count_distinct("campaign_name").alias("total_campaigns"),
        F.sum("actual_spend").alias("total_spend"),
        F.sum("leads").alias("total_leads"),
        F.sum("clicks").alias("total_clicks"),
        F.avg("actual_cpl").alias("avg_cpl"),
        F.avg("actual_cpc").alias("avg_cpc"),
        *_tier_counts(
            dict(zip(TIERS, ("excellent_campaigns", "good_campaigns", "average_campaigns", "below_avg_campaigns")))
        ),
        F.when(F.sum("clicks") > 0, ratio(F.sum("leads"), F.sum("clicks"))).alias("overall_conversion_rate"),
        F.when(F.sum("leads") > 0, ratio(F.sum("actual_spend"), F.sum("leads"))).alias("blended_cpl"),
        F.max("extracted_at").alias("last_updated"),
    )


def latest_months(dashboard: DataFrame, months: int = 12) -> DataFrame:
    """The newest dashboard months, newest first."""
    if not 1 <= months <= 24:
        raise ValueError("months must lie between 1 and 24")
    return dashboard.orderBy(F.desc_nulls_first("month")).limit(months)


def campaign_summary(perf: DataFrame, end: dt.date, start: dt.date | None = None) -> DataFrame:
    """One-row summary of a date range, by default the 30 days up to ``end``."""
    start = start or end - dt.timedelta(days=30)
    return perf.where(F.col("snapshot_date").between(F.lit(start), F.lit(end))).agg(
        F.count("*").alias("total_campaigns"),
        F.count_distinct("advertiser_name").alias("unique_advertisers"),
        F.count_distinct("channel").alias("unique_channels"),
        F.coalesce(F.sum("actual_spend"), F.lit(0.0)).alias("total_spend"),
        F.coalesce(F.sum("leads"), F.lit(0)).alias("total_leads"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("total_clicks"),
        F.avg("actual_cpl").alias("avg_cpl"),
        F.avg("actual_cpc").alias("avg_cpc"),
        F.avg("conversion_rate").alias("avg_conversion_rate"),
        *_tier_counts(dict(zip(TIERS, ("excellent_count", "good_count", "average_count", "below_avg_count")))),
    )


def performance_trend(
    perf: DataFrame, metric: str = "cpl", period: str = "month", channel: str | None = None, limit: int | None = 24
) -> DataFrame:
    """Metric per day, week (from Monday) or month; any other period means month."""
    if metric not in TREND_METRICS:
        raise ValueError(f"metric must be one of {sorted(TREND_METRICS)}")
    how, column = TREND_METRICS[metric]
    unit = period if period in TREND_PERIODS else "month"
    if channel is not None:
        perf = perf.where(F.col("channel") == channel)
    value = F.avg(column) if how == "avg" else F.sum(column)
    trend = perf.groupBy(F.date_trunc(unit, "snapshot_date").cast("date").alias("period")).agg(
        value.alias("metric_value"),
        F.count("*").alias("campaign_count"),
        F.count_distinct("advertiser_name").alias("advertiser_count"),
    )
    return trend if limit is None else trend.orderBy(F.desc_nulls_first("period")).limit(limit)


def partner_pipeline_health(pipeline: DataFrame, waterfall: DataFrame, as_of: dt.date) -> DataFrame:
    """Opportunities with the partner's budget movement on the day they were created, and a pipeline status."""
    stage, close = F.col("stage"), F.col("close_date")
    status = None
    for name, label in CLOSED_STAGES.items():
        status = F.when(stage == name, label) if status is None else status.when(stage == name, label)
    status = status.when(close < F.lit(as_of), "overdue").when(
        close <= F.date_add(F.lit(as_of), 30), "closing_soon"
    ).otherwise("pipeline")
    budgets = waterfall.select(
        F.col("advertiser_name").alias("_partner"),
        F.col("snapshot_date").alias("_day"),
        F.col("budgets").alias("partner_budget"),
        "starting_clients",
        "ending_clients",
        "new_clients",
        "churned_clients",
    )
    on = (F.col("partner_name") == F.col("_partner")) & (F.to_date("created_date") == F.col("_day"))
    return pipeline.join(budgets, on, "left").select(
        "partner_name",
        "opportunity_name",
        "stage",
        "amount",
        "close_date",
        "probability",
        "partner_budget",
        "starting_clients",
        "ending_clients",
        "new_clients",
        "churned_clients",
        status.alias("pipeline_status"),
        "created_date",
        "last_modified_date",
    )


def filter_pipeline(health: DataFrame, stage: str | None = None, partner_like: str | None = None) -> DataFrame:
    """Exact stage, and a case-insensitive partner pattern in which ``%`` and ``_`` keep their meaning."""
    if stage is not None:
        health = health.where(F.col("stage") == stage)
    if partner_like is not None:
        health = health.where(F.col("partner_name").ilike(f"%{partner_like}%"))
    return health


def top_opportunities(health: DataFrame, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie between 1 and 1000")
    return health.orderBy(
        F.desc_nulls_last("amount"), F.asc_nulls_last("close_date"), F.asc("opportunity_name")
    ).limit(limit)


def data_quality_monitor(campaigns: DataFrame, benchmarks: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Row counts, gap counts and date ranges of the three sources, one row each."""

    def profile(df, name, missing, weak, day, stamp):
        return df.agg(
            F.lit(name).alias("source_table"),
            F.count("*").alias("record_count"),
            F.count_if(missing).alias("null_spend_count"),
            F.count_if(weak).alias("zero_leads_count"),
            F.min(day).cast("date").alias("earliest_date"),
            F.max(day).cast("date").alias("latest_date"),
            F.max(stamp).cast("timestamp_ntz").alias("last_extraction"),
        )

    return (
        profile(
            campaigns, "campaigns", F.col("amount_spent").isNull(), F.col("running_cid_leads") == 0,
            "snapshot_date", "extracted_at",
        )
        .unionByName(
            profile(
                benchmarks, "benchmark_data", F.col("cpl_median").isNull(), F.col("sample_size") < 10,
                "snapshot_date", "snapshot_date",
            )
        )
        .unionByName(
            profile(
                pipeline, "partner_pipeline", F.col("amount").isNull(), F.col("stage").isNull(),
                "created_date", "last_modified_date",
            )
        )
    )


def quality_report(monitor: DataFrame) -> DataFrame:
    """The monitor in the shape reports show: counts never missing, dates as ISO text."""
    return monitor.select(
        "source_table",
        F.coalesce("record_count", F.lit(0)).alias("record_count"),
        F.coalesce("null_spend_count", F.lit(0)).alias("null_count"),
        F.coalesce("zero_leads_count", F.lit(0)).alias("low_count"),
        F.date_format("earliest_date", "yyyy-MM-dd").alias("earliest_date"),
        F.date_format("latest_date", "yyyy-MM-dd").alias("latest_date"),
    )


def hide_zeros(df: DataFrame, columns: list[str]) -> DataFrame:
    """Show zero amounts as missing, as some consumers expect."""
    return df.withColumns({c: zero_as_null(c) for c in columns})
