"""Load checks, freshness, alerts and run summaries, all as small aggregations over tables and logs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import wall_time
from .joins import top_per_key
from .risk.params import CATEGORY_LTV

# Parts of a column name that mark a table as campaign data.
CAMPAIGN_NAME_PARTS = ("campaign", "mcid", "maid", "cpl", "leads", "advertiser")


@dataclass(frozen=True)
class AlertLimits:
    """Limits of the health alerts."""

    stale_hours: float = 26.0
    broken_hours: float = 48.0
    failed_jobs: int = 3
    disk_percent: float = 85.0
    disk_critical: float = 95.0


def load_checks(table: DataFrame, keys: Sequence[str], stamp: str = "extracted_at") -> DataFrame:
    """Rows, NULLs per key column and the extraction range, in one pass."""
    return table.agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(F.col(k).isNull()).alias(f"{k}_nulls") for k in keys],
        F.min(stamp).alias("min_date"),
        F.max(stamp).alias("max_date"),
    )


def load_status(table: DataFrame, name: str, stamp: str = "extracted_at", day: str = "snapshot_date") -> DataFrame:
    return table.agg(
        F.lit(name).alias("table_name"),
        F.count("*").alias("total_rows"),
        F.max(stamp).alias("last_load"),
        F.count_distinct(day).alias("unique_extract_dates"),
    ).withColumn("status", F.when(F.col("total_rows") > 0, "healthy").otherwise("no_data"))


def table_coverage(tables: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Row count and latest date per table; the second item of each entry names its date column."""
    out = None
    for name, (df, day) in tables.items():
        latest = F.max(F.col(day).cast("date")) if day else F.max(F.lit(None).cast("date"))
        row = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"), latest.alias("latest_date"))
        out = row if out is None else out.unionByName(row)
    return out


def coverage_totals(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count("*").alias("tables"),
        F.count_if(F.col("row_count") > 0).alias("tables_with_data"),
        F.sum("row_count").alias("total_rows"),
        F.max_by("table_name", F.struct("row_count", "table_name")).alias("largest_table"),
    )


def freshness_hours(stamps: Sequence[tuple[DataFrame, str]], as_of: dt.datetime) -> DataFrame:
    """Hours since the newest extraction over several tables; infinity when none has data."""
    newest = None
    for df, column in stamps:
        row = df.agg(F.max(column).cast("timestamp_ntz").alias("latest"))
        newest = row if newest is None else newest.unionByName(row)
    micros = F.timestamp_diff("MICROSECOND", F.col("latest"), wall_time(as_of))
    return newest.agg(F.max("latest").alias("latest")).select(
        "latest", F.coalesce(micros / F.lit(3.6e9), F.lit(float("inf"))).alias("freshness_hours")
    )


def health_alerts(metrics: DataFrame, limits: AlertLimits = AlertLimits()) -> DataFrame:
    """Alert rows for metric rows that break a limit. Absent metrics never alert."""
    have = set(metrics.columns)
    alerts = []

    def alert(column, test, kind, level, message):
        if column in have:
            alerts.append(
                F.when(test, F.struct(F.lit(kind).alias("alert_type"), level.alias("level"), message.alias("message")))
            )

    stale, failed, disk = F.col("freshness_hours"), F.col("failed_jobs_24h"), F.col("disk_usage_percent")
    alert("database_healthy", ~F.col("database_healthy"), "database_error", F.lit("critical"), F.lit("Database connection failed"))
    alert(
        "freshness_hours", stale > limits.stale_hours, "data_quality",
        F.when(stale < limits.broken_hours, "warning").otherwise("error"),
        F.format_string("Data is %.1f hours old", stale),
    )
    alert(
        "failed_jobs_24h", failed > limits.failed_jobs, "job_failed", F.lit("warning"),
        F.format_string("%d jobs failed in the last 24 hours", failed),
    )
    alert(
        "disk_usage_percent", disk > limits.disk_percent, "system_error",
        F.when(disk < limits.disk_critical, "warning").otherwise("critical"),
        F.format_string("Disk usage at %.1f%%", disk),
    )
    keep = [c for c in metrics.columns if c not in ("database_healthy", "freshness_hours", "failed_jobs_24h", "disk_usage_percent")]
    return metrics.select(*keep, F.inline(F.array_compact(F.array(*alerts))))


def alert_counts(alerts: DataFrame, active: str = "active") -> DataFrame:
    """Active alerts by level and by type, as (dimension, value, alerts) rows."""
    pairs = F.array(
        F.struct(F.lit("level").alias("dimension"), F.col("level").alias("value")),
        F.struct(F.lit("type").alias("dimension"), F.col("alert_type").alias("value")),
    )
    return alerts.where(F.col(active)).select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("alerts"))


def alert_subtotals(alerts: DataFrame, active: str = "active") -> DataFrame:
    """Active alerts per (level, type) with the subtotals of each level, each type and the grand total, from one
    aggregation (a cube: the rows are expanded four ways and counted in the same shuffle). ``grouping`` tells the rows
    apart: 0 for a pair, 1 for a level's subtotal, 2 for a type's, 3 for the total; a null level or type of an alert is
    a value of its own and stays apart from the subtotal rows by this number. An empty input gives no rows."""
    return alerts.where(F.col(active)).cube("level", "alert_type").agg(
        F.grouping_id().alias("grouping"), F.count("*").alias("alerts"))


def recent_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.orderBy(F.desc_nulls_last("created_at"), F.desc("alert_id")).limit(n)


def within_hours(log: DataFrame, as_of: dt.datetime, hours: int = 24, stamp: str = "created_at") -> DataFrame:
    """Log rows of the last ``hours``."""
    return log.where(F.col(stamp) >= wall_time(as_of - dt.timedelta(hours=hours)))


def last_executions(run_log: DataFrame, n: int = 5) -> DataFrame:
    """The newest runs of every job. Map tasks keep ``n`` rows per job before anything is shuffled."""
    return top_per_key(run_log, ["job_id"], [F.desc("started_at"), F.desc("run_id")], n, "recency")


def run_summary(run_log: DataFrame) -> DataFrame:
    """Successes per group of a run."""
    return run_log.groupBy("group").agg(
        F.count_if("success").alias("succeeded"), F.count("*").alias("total")
    )


def run_status(run_log: DataFrame) -> DataFrame:
    """Overall outcome: all, some or none, with the exit code and level that go with it."""
    done, total = F.col("succeeded"), F.col("total")
    return run_log.agg(F.count_if("success").alias("succeeded"), F.count("*").alias("total")).withColumns(
        {
            "outcome": F.when(done == total, "all").when(done > 0, "some").otherwise("none"),
            "exit_code": F.when(done == total, 0).when(done > 0, 1).otherwise(2),
            "level": F.when(done == total, "INFO").when(done > 0, "WARN").otherwise("CRIT"),
        }
    )


def pipeline_status(run_log: DataFrame) -> DataFrame:
    """``completed`` when extraction had any success and every load finished; a skipped phase counts as done."""
    phase = F.col("phase")
    return run_log.agg(
        F.count_if(phase == "extract").alias("extractions"),
        F.count_if((phase == "extract") & F.col("success")).alias("extracted"),
        F.count_if((phase == "load") & ~F.col("success")).alias("failed_loads"),
    ).withColumn(
        "status",
        F.when(((F.col("extractions") == 0) | (F.col("extracted") > 0)) & (F.col("failed_loads") == 0), "completed").otherwise("partial"),
    )


def reconcile_counts(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows per ``key`` on both sides; an empty source matches anything."""
    a = source.groupBy(key).agg(F.count("*").alias("source_rows"))
    b = target.groupBy(key).agg(F.count("*").alias("target_rows"))
    zero = F.lit(0)
    return a.join(b, key, "full").select(
        key,
        F.coalesce("source_rows", zero).alias("source_rows"),
        F.coalesce("target_rows", zero).alias("target_rows"),
    ).withColumn("matches", (F.col("source_rows") == F.col("target_rows")) | (F.col("source_rows") == 0))


def unknown_ids(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested ids that do not exist."""
    return requested.select(key).distinct().join(known.select(key), key, "left_anti")


def with_lifetime_value(df: DataFrame, category: str = "business_category") -> DataFrame:
    """Lifetime value of a campaign's category; an unknown category gets the mean over all categories."""
    values = F.create_map(*[F.lit(x) for pair in CATEGORY_LTV.items() for x in pair])
    mean = sum(CATEGORY_LTV.values()) / len(CATEGORY_LTV)
    return df.withColumn("category_ltv", F.coalesce(F.try_element_at(values, F.col(category)).cast("double"), F.lit(mean)))


def average_lifetime_value(df: DataFrame, category: str = "business_category") -> DataFrame:
    """Mean lifetime value over campaigns, per category and overall."""
    return with_lifetime_value(df, category).groupBy(category).agg(
        F.avg("category_ltv").alias("average_ltv"), F.count("*").alias("campaigns")
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Column, type, non-null count and distinct-free min/max of every column, one pass over the table."""
    entries = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.lit(t).alias("data_type"),
            F.count(n).alias("non_null"),
            F.min(n).cast("string").alias("min_value"),
            F.max(n).cast("string").alias("max_value"),
        )
        for n, t in df.dtypes
    ]
    return df.agg(F.array(*entries).alias("p"), F.count("*").alias("rows")).select("rows", F.inline("p"))


#: HLL sketches of 2^12 registers: relative standard error of a distinct count 1.04 / 64, about 1.6 %.
SKETCH_LG_K = 12


def _sketchable(name: str, dtype: str):
    """Column as a type that HLL sketches take (int, bigint, string, binary); other types by their text, which keeps
    distinct values distinct."""
    c = F.col(f"`{name}`")
    if dtype in ("int", "bigint", "string", "binary"):
        return c
    if dtype in ("tinyint", "smallint"):
        return c.cast("int")
    return c.cast("string")


def column_profile(df: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """``table_profile`` with an estimated distinct count per column, all in one aggregation over one scan.

    Distinct counts come from HLL sketches that merge across partitions before the shuffle (relative standard error
    about 1.04 / sqrt(2^lg_k), 1.6 % at the default); nulls are not counted. Columns of complex types get no
    min, max or distinct count (null). An empty table gives every column with zero counts."""
    entries = []
    for n, t in df.dtypes:
        simple = not t.startswith(("array", "map", "struct", "variant"))
        c = F.col(f"`{n}`")
        entries.append(F.struct(
            F.lit(n).alias("column_name"), F.lit(t).alias("data_type"), F.count(c).alias("non_null"),
            (F.min(c).cast("string") if simple else F.lit(None).cast("string")).alias("min_value"),
            (F.max(c).cast("string") if simple else F.lit(None).cast("string")).alias("max_value"),
            (F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(_sketchable(n, t), lg_k)), F.lit(0)) if simple
             else F.lit(None).cast("long")).alias("approx_distinct"),
        ))
    return df.agg(F.array(*entries).alias("p"), F.count("*").alias("rows")).select("rows", F.inline("p"))


def frequent_values(df: DataFrame, columns: list[str], support: float = 0.01) -> DataFrame:
    """(column_name, value) for values that may occur in more than ``support`` of the rows, one pass over all columns
    with Spark's mergeable frequent-items counters: every value above the support is listed, some below it may be
    too. Values are given as text; nulls count as values."""
    found = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns]).stat.freqItems(columns, support)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}_freqItems`").alias("values")) for c in columns])
    return found.select(F.inline(pairs)).select("column_name", F.explode_outer("values").alias("value"))


def sample_rows(df: DataFrame, rows: int = 3) -> DataFrame:
    """Some rows of a table as JSON text, for a look at it; which ones is not fixed. Spark stops reading when it has them."""
    return df.limit(rows).select(F.to_json(F.struct("*")).alias("row"))


def campaign_samples(spark: SparkSession, database: str | None = None, rows: int = 3) -> dict[str, list[str]]:
    """Sample rows of every catalog table with campaign-like columns."""
    names = campaign_tables(spark, database)
    return {n: [r["row"] for r in sample_rows(spark.table(n if database is None else f"{database}.{n}"), rows).collect()] for n in names}


def campaign_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of catalog tables with campaign-like columns."""
    hits = []
    for t in spark.catalog.listTables(database):
        columns = [c.name.lower() for c in spark.catalog.listColumns(t.name if database is None else f"{database}.{t.name}")]
        if any(part in c for c in columns for part in CAMPAIGN_NAME_PARTS):
            hits.append(t.name)
    return hits
