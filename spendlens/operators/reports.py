"""Named reports over the performance views, with a default date range per report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import performance as perf_ops


@dataclass(frozen=True)
class ReportViews:
    """Builders of the views a report may read; a report only builds the one it needs."""

    performance: Callable[[], DataFrame]
    pipeline: Callable[[], DataFrame]
    dashboard: Callable[[], DataFrame]
    quality: Callable[[], DataFrame]


@dataclass(frozen=True)
class Report:
    title: str
    days_back: int
    build: Callable[[ReportViews, dt.date, dt.date, dict], DataFrame]


def _performance(views: ReportViews, start, end, filters) -> DataFrame:
    rows = perf_ops.filter_performance(
        views.performance(), start, end, filters.get("channel"), filters.get("performance_tier")
    )
    return rows.orderBy(F.desc_nulls_first("snapshot_date"), F.desc_nulls_last("actual_spend")).drop(
        "benchmark_cpc_median", "extracted_at"
    )


def _pipeline(views: ReportViews, start, end, filters) -> DataFrame:
    rows = views.pipeline().where(F.col("created_date").between(F.lit(start), F.lit(end)))
    rows = perf_ops.filter_pipeline(rows, filters.get("stage"), filters.get("partner_name"))
    return rows.orderBy(F.desc_nulls_last("amount"), F.asc_nulls_last("close_date")).drop(
        "starting_clients", "ending_clients", "new_clients", "churned_clients"
    )


def _executive(views: ReportViews, start, end, filters) -> DataFrame:
    month = F.col("month")
    inside = month.between(F.trunc(F.lit(start), "month"), F.trunc(F.lit(end), "month"))
    return views.dashboard().where(inside).orderBy(F.desc_nulls_first("month")).drop("last_updated")


def _quality(views: ReportViews, start, end, filters) -> DataFrame:
    return views.quality().select(
        "source_table", "record_count", "earliest_date", "latest_date", "last_extraction"
    ).orderBy("source_table")


REPORTS = {
    "campaign_performance": Report("Campaign Performance Report", 30, _performance),
    "partner_pipeline": Report("Partner Pipeline Report", 90, _pipeline),
    "executive_summary": Report("Executive Summary Report", 365, _executive),
    "data_quality": Report("Data Quality Report", 30, _quality),
}


def date_range(name: str, as_of: dt.date, start: dt.date | None = None, end: dt.date | None = None):
    end = end or as_of
    return start or end - dt.timedelta(days=REPORTS[name].days_back), end


def build_report(
    name: str,
    views: ReportViews,
    as_of: dt.date,
    start: dt.date | None = None,
    end: dt.date | None = None,
    filters: dict | None = None,
) -> DataFrame:
    """A report as a lazy DataFrame."""
    if name not in REPORTS:
        raise KeyError(f"unknown report {name!r}; have {sorted(REPORTS)}")
    start, end = date_range(name, as_of, start, end)
    return REPORTS[name].build(views, start, end, filters or {})


def export_csv(report: DataFrame, path: str) -> None:
    """CSV with a header. An empty report becomes the single line ``No data available``."""
    if report.isEmpty():
        report.sparkSession.range(1).select(F.lit("No data available").alias("value")).write.mode("overwrite").text(path)
    else:
        report.write.mode("overwrite").csv(path, header=True)


def export_json(report: DataFrame, path: str) -> None:
    """JSON lines: every number as a double, dates and timestamps in ISO form."""
    report.select(*json_ready(report)).write.mode("overwrite").json(path)


def json_ready(report: DataFrame):
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "decimal")
    out = []
    for name, kind in report.dtypes:
        if kind.startswith(numeric):
            out.append(F.col(name).cast("double").alias(name))
        elif kind == "date":
            out.append(F.date_format(name, "yyyy-MM-dd").alias(name))
        elif kind.startswith("timestamp"):
            out.append(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss").alias(name))
        else:
            out.append(F.col(name))
    return out
