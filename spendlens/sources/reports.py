"""Semi-structured inputs: CRM report documents and the nested benchmark file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRM_REPORT = (
    "struct<reportMetadata: struct<detailColumns: array<string>>,"
    " reportExtendedMetadata: struct<detailColumnInfo: map<string, struct<label: string>>>,"
    " factMap: map<string, struct<rows: array<struct<dataCells: array<struct<label: string, value: string>>>>>>>"
)

# Percentile names per metric of the benchmark file.
SPREAD = ("top10", "top25", "avg", "bot25", "bot10")
BUDGET_SPREAD = ("p10_bottom", "p25_bottom", "avg", "p25_top", "p10_top")
WHOLE_TABLE_BLOCK = "T!T"
VERSION_KEY = "_version"


def _metric(parts: Sequence[str]) -> str:
    return f"struct<median: string, dms: struct<{', '.join(f'{p}: string' for p in parts)}>>"


BENCHMARK_FILE = (
    "struct<version: string, date: string, records: map<string, struct<"
    "meta: struct<category: string, subcategory: string>,"
    f" cpl: {_metric(SPREAD)}, cpc: {_metric(SPREAD)}, ctr: {_metric(SPREAD)}, budget: {_metric(BUDGET_SPREAD)},"
    " sample_size: int, confidence_level: double, data_quality_score: double>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``source_file`` and its whole ``text`` without a byte-order mark."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("text")
    )


def parse_crm_reports(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.withColumn("report", F.from_json(text, CRM_REPORT))


def _plain(cell: Column) -> Column:
    """A cell value; amounts arrive as an object with ``amount``."""
    value = cell["value"]
    return F.when(value.startswith("{"), F.coalesce(F.get_json_object(value, "$.amount"), value)).otherwise(value)


def numbered(labels: Column) -> Column:
    """Labels with ``_2``, ``_3`` and so on behind repeated ones; a number that is itself a label is repeated in turn."""

    def unique(label: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(labels, 1, i), lambda x: x == label))
        plain = F.concat(label, F.lit("_"), before + 1)
        return F.when(before == 0, label).when(F.array_contains(labels, plain), F.concat(plain, F.lit("_"), i + 1)).otherwise(plain)

    return F.transform(labels, unique)


def flatten_all_blocks(reports: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every detail row of every block with a ``cells`` map from column label to value.

    Short rows leave their last columns NULL; cells beyond the known columns are dropped. Where columns share a label, the
    second and later ones get a number: ``Amount``, ``Amount_2``.
    """
    info = F.col("report.reportExtendedMetadata.detailColumnInfo")
    labels = F.transform(
        "report.reportMetadata.detailColumns",
        lambda name: F.coalesce(F.nullif(F.try_element_at(info, name)["label"], F.lit("")), name),
    )
    headers = numbered(labels)
    blocks = reports.select(*keep, headers.alias("headers"), F.explode("report.factMap").alias("block", "b"))
    rows = blocks.select(*keep, "headers", "block", F.posexplode("b.rows").alias("row_no", "r"))
    cells = F.transform("headers", lambda name, i: _plain(F.get(F.col("r.dataCells"), i)))
    return rows.select(*keep, "block", "row_no", F.map_from_arrays("headers", cells).alias("cells"))


def flatten_first_block(reports: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Detail rows of the first block that has any: the whole-table block, then other ``…!T`` blocks.

    Cells show their label, else their value, else ''. Columns carry API names; extra cells ``Column_<i>``.
    """
    entries = F.filter(
        F.map_entries("report.factMap"),
        lambda e: e["key"].endswith("!T") & (F.coalesce(F.size(e["value"]["rows"]), F.lit(0)) > 0),
    )
    whole = F.filter(entries, lambda e: e["key"] == WHOLE_TABLE_BLOCK)
    first = F.coalesce(F.get(whole, F.lit(0)), F.get(entries, F.lit(0)))
    names = F.col("report.reportMetadata.detailColumns")
    rows = reports.withColumn("b", first).select(
        *keep, "report", F.col("b.key").alias("block"), F.posexplode("b.value.rows").alias("row_no", "r")
    )
    cells = F.transform(
        "r.dataCells",
        lambda c, i: F.struct(
            F.coalesce(F.get(names, i), F.concat(F.lit("Column_"), i.cast("string"))).alias("key"),
            F.coalesce(c["label"], c["value"], F.lit("")).alias("value"),
        ),
    )
    return rows.select(*keep, "block", "row_no", F.map_from_entries(cells).alias("cells"))


def reports_without_rows(reports: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Reports to reject: no detail columns declared, or no detail row in any block."""
    rows = F.aggregate(
        F.coalesce(F.map_values("report.factMap"), F.array()),
        F.lit(0),
        lambda n, b: n + F.greatest(F.coalesce(F.size(b["rows"]), F.lit(0)), F.lit(0)),
    )
    columns = F.coalesce(F.size("report.reportMetadata.detailColumns"), F.lit(0))
    reason = F.when(columns <= 0, "no detail columns").when(rows == 0, "no detail rows")
    return reports.select(*keep, reason.alias("reject_reason")).where("reject_reason is not null")


def cells_to_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c != "cells"]
    return rows.select(*rest, *[F.try_element_at("cells", F.lit(n)).alias(n) for n in names])


def parse_benchmark_files(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.withColumn("file", F.from_json(text, BENCHMARK_FILE))


def benchmark_rows(files: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per record with wide metric columns. Unreadable numbers are NULL; the version marker is skipped."""
    rows = files.select(*keep, F.explode("file.records").alias("key", "rec")).where(F.col("key") != VERSION_KEY)
    columns = []
    for name, parts in (("cpl", SPREAD), ("cpc", SPREAD), ("ctr", SPREAD), ("budget", BUDGET_SPREAD)):
        columns.append(F.col(f"rec.{name}.median").try_cast("double").alias(f"{name}_median"))
        columns += [F.col(f"rec.{name}.dms.{p}").try_cast("double").alias(f"{name}_{p}") for p in parts]
    unknown = F.lit("unknown")
    return rows.select(
        *keep,
        "key",
        F.coalesce("rec.meta.category", unknown).alias("category"),
        F.coalesce("rec.meta.subcategory", unknown).alias("subcategory"),
        *columns,
        "rec.sample_size",
        "rec.confidence_level",
        "rec.data_quality_score",
    )


def benchmark_snapshots(files: DataFrame, text: str = "text") -> DataFrame:
    """Version, snapshot date from a file name that starts with one, record count and checksum per file."""
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    day = F.try_to_date(F.regexp_extract(stem, r"^(20\d{2}-\d{1,2}-\d{1,2})(?:-|$)", 1), "yyyy-M-d")
    return files.select(
        "source_file",
        F.coalesce("file.version", "file.date", stem).alias("version"),
        day.alias("snapshot_date"),
        F.size(F.filter(F.map_keys("file.records"), lambda k: k != VERSION_KEY)).alias("records_count"),
        F.sha2(text, 256).alias("file_checksum"),
    )


def as_variant(documents: DataFrame, text: str = "text", out: str = "doc") -> DataFrame:
    """documents with ``out``: the JSON text as a Variant, whatever its shape; text that is no JSON gives null."""
    return documents.withColumn(out, F.try_parse_json(F.col(text)))


def document_fields(documents: DataFrame, keys: Sequence[str], doc: str = "doc") -> DataFrame:
    """One row per top-level field of each Variant document: keys, field, value as JSON text, its type. Documents of
    unlike shape share these columns; an object without fields, a non-object and a null give no rows."""
    entries = F.try_variant_get(F.col(doc), "$", "map<string, variant>")
    fields = documents.select(*keys, F.explode(entries).alias("field", "value"))
    return fields.select(
        *keys, "field", F.to_json("value").alias("value"), F.expr("schema_of_variant(value)").alias("value_type"))


def document_value(doc: Column, path: str, kind: str = "string") -> Column:
    """The value at a JSON path of a Variant document as ``kind``; null where absent or of another kind."""
    return F.try_variant_get(doc, path, kind)
