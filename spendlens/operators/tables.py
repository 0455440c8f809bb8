"""Keeping curated Parquet tables current: upserts, loads of unseen rows, refreshes and replacements.

Plain Parquet has no row updates, so every change is a new DataFrame, published as a new version directory behind
a catalog view. Readers switch when the view is replaced; a failed write leaves the old version in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .joins import newest_per_key


def _known(keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).isNotNull()
    return test


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], stamp: str | None = None) -> DataFrame:
    """Current rows with changes applied on ``keys``.

    The last change per key by ``order`` replaces every column of its row. As in SQL, a NULL in a key equals
    nothing: such changes are appended. ``stamp`` names a column set to the current time on changed rows.
    """
    complete = _known(keys)
    last = newest_per_key(changes.where(complete), keys, [F.desc_nulls_last(c) for c in order])
    fresh = last.unionByName(changes.where(~complete))
    if stamp is not None:
        fresh = fresh.withColumn(stamp, F.current_timestamp())
    untouched = current.join(last.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(fresh, allowMissingColumns=True)


def _same(keys: Sequence[str]) -> Column:
    test = None
    for k in keys:
        pair = _text_key(f"s.{k}") == _text_key(f"h.{k}")
        test = pair if test is None else test & pair
    return test


def _text_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unseen_rows(staged: DataFrame, stored: DataFrame, keys: Sequence[str], compat: bool = False) -> DataFrame:
    """Staged rows whose keys are not stored yet; a missing key part equals the empty text.

    ``compat`` keeps a loader habit: a stored row with a missing first key is not recognised, so its match is
    inserted again with every load.
    """
    if not compat:
        return staged.alias("s").join(stored.alias("h"), _same(keys), "left_anti")
    marked = stored.select(*[_text_key(k).alias(f"_{k}") for k in keys],
                           F.col(keys[0]).isNull().alias("_hole"))
    on = None
    for k in keys:
        pair = _text_key(k) == F.col(f"_{k}")
        on = pair if on is None else on & pair
    joined = staged.join(marked, on, "left")
    return joined.where(F.coalesce("_hole", F.lit(True))).select(*staged.columns)


def load_unseen(staged: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append unseen rows to the history at ``path`` and return how many, counted while they are written."""
    stored = staged.sparkSession.read.parquet(path)
    written = Observation("load_unseen")
    rows = unseen_rows(staged, stored, keys).observe(written, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("append").parquet(path)
    return written.get["rows"]


def add_categories(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Category rows to append: pairs that are not known yet, with display name and active flag."""
    pair = ["category", "subcategory"]
    new = seen.select(*pair).distinct().join(known.select(*pair), pair, "left_anti")
    name = F.when(F.col("category") == F.col("subcategory"), F.col("category")).otherwise(
        F.concat_ws(" - ", "category", "subcategory")
    )
    return new.withColumns({"display_name": name, "active": F.lit(True)})


def publish(df: DataFrame, view: str, root: str, version: str) -> str:
    """Write ``df`` as ``root/version=<version>`` and point the view at it. Rewriting a version is idempotent."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).createOrReplaceTempView(view)
    return path


def refresh(build, view: str, root: str, version: str) -> str:
    """Recompute a materialized view and publish it."""
    return publish(build(), view, root, version)


def replace_files(df: DataFrame, path: str, partition: str = "source_file") -> None:
    """Replace the rows of the source files in ``df`` and leave all others alone."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts as JSON lines with an ISO timestamp."""
    alerts.write.mode("append").json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss")


def snapshot_entry(table: DataFrame, file_name: str, snapshot_date, file_size: int) -> DataFrame:
    """Registry row of a finished load."""
    return table.agg(
        F.lit(snapshot_date).cast("date").alias("snapshot_date"),
        F.lit(file_name).alias("file_name"),
        F.lit(file_size).cast("bigint").alias("file_size_bytes"),
        F.count("*").alias("record_count"),
        F.current_timestamp().alias("last_modified"),
    )


def create_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Drop and create the catalog table ``name`` from the frame's own schema (columns and types as inferred by the
    reader), with its rows; at ``path`` if given (an external table), else in the warehouse. Returns the new table."""
    writer = df.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
