"""From a text table to a curated one: cleaning by column name, metadata, rejects and the upsert that ends a load."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..functions.columns import wall_time
from ..functions.headers import clean_headers
from ..operators import tables
from ..sources.configs import Source
from ..sources.files import FILE_DATE, PLACE, classified, read_reports, refused_files


def clean_table(df: DataFrame, text_mode: str | None = None) -> DataFrame:
    """Null tokens, dates, numbers and empty rows, decided by column name.

    ``text_mode`` also repairs the text of exports with mixed encodings (see ``unicode_text``). Text columns
    whose name looks numeric become NULL where they hold no number.
    """
    data = [c for c in df.columns if c not in PLACE]
    out = {}
    for name in data:
        cell = F.col(name).cast("string")
        if text_mode:
            cell = cl.unicode_text(cell, text_mode)
        cell = cl.null_tokens(cell)
        if cl.is_date_name(name):
            cell = cl.parse_date(cell)
        if cl.is_numeric_name(name):
            cell = cl.numeric_cell(cell)
        out[name] = cell
    return df.withColumns(out).na.drop("all", subset=data)


def add_metadata(df: DataFrame, loaded_at: dt.datetime, as_of: dt.date) -> DataFrame:
    """``snapshot_date`` from the file name, else ``as_of``; and the load time."""
    day = F.try_to_date(F.regexp_extract("source_file", FILE_DATE, 1), "yyyy-MM-dd")
    return df.withColumns(
        {"snapshot_date": F.coalesce(day, F.lit(as_of)), "extracted_at": wall_time(loaded_at)}
    )


def ingest(
    spark: SparkSession, path: str, source: Source, loaded_at: dt.datetime, as_of: dt.date, latest: bool = False,
    text_mode: str | None = "compat",
) -> DataFrame:
    """Files of a source as a cleaned table with metadata. ``text_mode`` says how the text of sources with mixed encodings
    is repaired: ``compat`` also joins words, ``collapse`` keeps them apart, None leaves the text."""
    raw = read_reports(spark, path, source, latest)
    return add_metadata(clean_table(raw, text_mode if source.mixed_encoding else None), loaded_at, as_of)


def rejected_reports(spark: SparkSession, path: str, source: Source) -> DataFrame:
    """(file_name, length, reject_reason) of the files that ``ingest`` leaves out."""
    return refused_files(classified(spark, path, source.pattern), source).select("file_name", "length", "reject_reason")


def unparsed_dates(raw: DataFrame) -> DataFrame:
    """(column_name, n_cells, n_unparsed) for each column that is read as a date: cells with a text, and those that
    become NULL because no spelling fits."""
    names = [c for c in raw.columns if c not in PLACE and cl.is_date_name(c)]
    if not names:
        return raw.sparkSession.createDataFrame([], "column_name string, n_cells long, n_unparsed long")
    cell = cl.null_tokens(F.trim(F.col("cell")))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("cell")) for c in names]))
    cells = raw.select(pairs.alias("p")).select("p.*")
    lost = cell.isNotNull() & cl.parse_date(cell).isNull()
    return cells.groupBy("column_name").agg(F.count(cell).alias("n_cells"), F.count_if(lost).alias("n_unparsed"))


def split_rejects(df: DataFrame, source: Source) -> tuple[DataFrame, DataFrame]:
    """Rows with a complete natural key, and the others with the reason."""
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in source.keys]))
    marked = df.withColumn("_missing", missing)
    good = marked.where(F.size("_missing") == 0).drop("_missing")
    bad = marked.where(F.size("_missing") > 0).withColumn(
        "reject_reason", F.concat(F.lit("missing "), F.array_join("_missing", ", "))
    )
    return good, bad.drop("_missing")


def load(current: DataFrame | None, fresh: DataFrame, source: Source) -> DataFrame:
    """Curated table after a load. Of several rows of one key the last one wins: by load time, then file, then place in it."""
    order = [c for c in ("extracted_at", *PLACE) if c in fresh.columns]
    base = fresh.limit(0) if current is None else current
    return tables.upsert(base, fresh, source.keys, order).drop("source_row")


# Header of the daily performance report and the campaign column each one fills (fixed values of that report).
PERFORMANCE_REPORT = {
    "campaign_id": ("Campaign ID", "string"),
    "maid": ("MAID", "string"),
    "advertiser_name": ("Advertiser Name", "string"),
    "partner_name": ("BID Name", "string"),
    "bid_name": ("BID Name", "string"),
    "campaign_name": ("Campaign Name", "string"),
    "am": ("AM", "string"),
    "optimizer": ("Optimizer 1", "string"),
    "gm": ("AM Manager", "string"),
    "business_category": ("BC", "string"),
    "campaign_budget": ("Campaign Budget", "double"),
    "amount_spent": ("Amount Spent", "double"),
    "io_cycle": ("IO Cycle", "double"),
    "avg_cycle_length": ("Avg Cycle Length", "double"),
    "days_elapsed": ("Days Elapsed", "double"),
    "utilization": ("Utilization", "double"),
    "running_cid_leads": ("Running CID Leads", "double"),
    "running_cid_cpl": ("Running CID CPL", "double"),
    "cpl_goal": ("CPL Goal", "double"),
    "bsc_cpl_avg": ("BSC CPL Avg", "double"),
}


def campaigns_from_report(report: DataFrame) -> DataFrame:
    """Model input from the performance report, with the defaults assumed for what it lacks."""
    have = set(report.columns)
    out = []
    for name, (header, kind) in PERFORMANCE_REPORT.items():
        source = header if header in have else clean_headers([header])[0]
        cell = F.col(f"`{source}`") if source in have else F.lit(None)
        out.append(cl.number(cell).alias(name) if kind == "double" else cell.cast("string").alias(name))
    df = report.select(*out)
    return df.withColumns(
        {
            "io_cycle": F.coalesce("io_cycle", F.lit(1.0)),
            "days_active": F.col("days_elapsed"),
            "utilization": cl.percent_to_fraction("utilization", "amount_spent", "campaign_budget", "avg_cycle_length"),
            "effective_cpl_goal": F.col("cpl_goal"),
            "advertiser_product_count": F.lit(1),
            "bsc_cpc_average": F.lit(3.0),
            "status": F.lit("active"),
        }
    )
