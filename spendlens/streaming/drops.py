"""Daily drops as a stream of files: every run takes what is new, cleans it and applies it to the curated table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tables


# Folder levels of the table: the bucket of a key, its version, and the batch that wrote it.
LAYOUT = ("_bucket", "_version", "_batch")


def drop_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """File stream over a drop folder, with ``source_file``. CSV files must have the columns of ``schema`` in its order; a file
    with another header stops the stream instead of filling the wrong columns."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("escape", '"')
    return reader.load(path).withColumn("source_file", F.col("_metadata.file_name"))


def current_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """The table at ``root``: for each bucket the rows of its newest version. None if nothing was written yet."""
    try:
        rows = spark.read.option("basePath", root).parquet(root)
    except AnalysisException:
        return None
    return _newest(rows).drop(*LAYOUT)


def _newest(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("_bucket").agg(F.max(F.struct("_version", "_batch")).alias("n"))
    newest = newest.select("_bucket", "n._version", "n._batch")  # a row per bucket, from folder names
    return rows.join(F.broadcast(newest), list(LAYOUT), "left_semi")


def apply_drops(
    stream: DataFrame, root: str, view: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, transform=None,
    buckets: int = 64,
) -> StreamingQuery:
    """Upsert every micro-batch into the table at ``root`` and stop when nothing is left. ``view`` shows its newest rows.

    Rows lie in ``buckets`` by the hash of their key. A batch rewrites the buckets in which it has rows, as a new version
    of each beside the old one; files of other buckets are not touched, and readers of old versions are not disturbed.
    What is there already is always the base, also when the checkpoint is new. A batch that is repeated after a failure
    does not see what it wrote itself and writes the same versions again. The number of buckets is fixed with the first
    batch. ``forget_versions`` lists what a clean-up may delete.
    """
    spark = stream.sparkSession
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def apply(batch: DataFrame, batch_id: int) -> None:
        name = f"{run}-{batch_id}"
        rows = transform(batch) if transform else batch
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        changes = rows.withColumn("_bucket", bucket)
        try:
            stored = spark.read.option("basePath", root).parquet(root).where(F.col("_batch") != name)
        except AnalysisException:
            stored = None
        last = 0 if stored is None else stored.agg(F.max("_version")).first()[0] or 0
        if stored is None:
            base = changes.limit(0)
        else:
            touched = changes.select("_bucket").distinct()
            base = _newest(stored).join(F.broadcast(touched), "_bucket", "left_semi").drop("_version", "_batch")
        # The bucket follows from the key, so it may take part in it; rows without a complete key are appended.
        done = tables.upsert(base, changes, ["_bucket", *keys], order)
        done = done.withColumns({"_version": F.lit(last + 1), "_batch": F.lit(name)})
        writer = done.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*LAYOUT).parquet(root)
        current_rows(spark, root).createOrReplaceTempView(view)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def forget_versions(spark: SparkSession, root: str, keep: int) -> DataFrame:
    """(_bucket, _version, _batch) of versions older than the newest ``keep`` of their bucket: folders a clean-up may delete."""
    known = spark.read.option("basePath", root).parquet(root).select(*LAYOUT).distinct()
    age = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc("_version"), F.desc("_batch")))
    return known.withColumn("_age", age).where(F.col("_age") > keep).drop("_age")
