"""The executive dashboard kept current from stored partials per day.

A dashboard month is a merge of its days. Each day is stored once as one row of sums, counts and the latest extract
time, and as bitmaps of the campaigns it holds (exact distinct counts: positions in a dictionary of campaign names,
one bitmap per 32,768 positions). A refresh takes the complete new rows of the changed days only: it numbers names
it has not seen, rewrites the partitions of those days and merges all partials per month. Older rows are never read
again; what the merge reads grows with the number of days, not with the rows of a day.

Layout below ``root``: ``names`` (campaign_name, id), ``days`` (sums, partitioned by snapshot_date) and ``bits``
(bucket, bitmap, partitioned by snapshot_date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..shared import written
from .performance import TIERS

TIER_NAMES = dict(zip(TIERS, ("excellent_campaigns", "good_campaigns", "average_campaigns", "below_avg_campaigns")))


def _paths(root: str) -> tuple[str, str, str]:
    root = root.rstrip("/")
    return f"{root}/names", f"{root}/days", f"{root}/bits"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _number_new_names(spark: SparkSession, rows: DataFrame, names_path: str) -> DataFrame:
    """The dictionary with the names of ``rows`` it lacked appended; ids are dense and never change or repeat.

    New names are numbered by partition offsets: each partition's names are counted (one row per partition), the
    counts are summed in order, and a name's id is its partition's offset plus its place there. No task holds more
    than its partition."""
    seen = rows.where(F.col("campaign_name").isNotNull()).select("campaign_name").distinct()
    base = 0
    if _exists(spark, names_path):
        known = spark.read.parquet(names_path)
        seen = seen.join(known, "campaign_name", "left_anti")
        base = known.agg(F.max("id")).first()[0] or 0  # one value
    placed = written(seen.select("campaign_name", F.spark_partition_id().alias("part"),
                                 F.monotonically_increasing_id().alias("mono")), "dictionary-new")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("mono").alias("first")).select(
        "part", "first", (F.lit(base) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("offset"))
    # offsets holds one row per partition of the new names
    return placed.join(F.broadcast(offsets), "part").select(
        "campaign_name", (F.col("offset") + F.col("mono") - F.col("first") + 1).cast("long").alias("id"))


def _day_partials(rows: DataFrame, names: DataFrame, days: list) -> tuple[DataFrame, DataFrame]:
    """(sums per day, bitmaps per day and bucket) of the changed days; a changed day without rows gets a sums row of
    zero rows, so that its old partials are replaced."""
    spark = rows.sparkSession
    sums = rows.groupBy("snapshot_date").agg(
        F.count("*").alias("n_rows"),
        F.sum("actual_spend").alias("spend"), F.sum("leads").alias("leads"), F.sum("clicks").alias("clicks"),
        F.sum("actual_cpl").alias("cpl_sum"), F.count("actual_cpl").alias("cpl_n"),
        F.sum("actual_cpc").alias("cpc_sum"), F.count("actual_cpc").alias("cpc_n"),
        *[F.count_if(F.col("cpl_performance_tier") == t).alias(n) for t, n in TIER_NAMES.items()],
        F.max("extracted_at").alias("last_updated"),
    )
    empty = spark.createDataFrame([(d,) for d in days], "snapshot_date date").join(sums, "snapshot_date", "left_anti")
    sums = sums.unionByName(empty.select("snapshot_date", F.lit(0).cast("long").alias("n_rows")),
                            allowMissingColumns=True)
    ids = rows.where(F.col("campaign_name").isNotNull()).join(names, "campaign_name").select("snapshot_date", "id")
    bits = ids.groupBy("snapshot_date", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))
    bare = sums.select("snapshot_date").join(bits, "snapshot_date", "left_anti")  # replaces old bitmaps of the day
    bits = bits.unionByName(bare.select("snapshot_date", F.lit(0).cast("long").alias("bucket"),
                                        F.lit(None).cast("binary").alias("bitmap")))
    return sums, bits


def refresh_dashboard(rows: DataFrame, days: list, root: str) -> DataFrame:
    """Store the partials of ``days`` from ``rows`` (the complete rows of those days, columns of
    ``campaign_performance``) below ``root`` and return the dashboard of every stored month, as
    ``executive_dashboard`` over all rows gives it.

    Rows of other days are ignored. A day in ``days`` without rows is removed; a month whose days hold no rows
    disappears. Null campaign names count in sums and not among distinct campaigns. The first call (nothing stored)
    builds from scratch: pass every row and every day."""
    spark = rows.sparkSession
    names_path, days_path, bits_path = _paths(root)
    rows = rows.where(F.col("snapshot_date").isin(list(days)))
    new = _number_new_names(spark, rows, names_path)
    new.write.mode("append").parquet(names_path)
    names = spark.read.parquet(names_path)
    sums, bits = _day_partials(rows, names, days)
    for df, path in ((sums, days_path), (bits, bits_path)):  # one file per day: a day's partials are small
        df.repartition("snapshot_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)
    return stored_dashboard(spark, root, (sums.schema, bits.schema))


def stored_dashboard(spark: SparkSession, root: str, schemas=None) -> DataFrame:
    """The dashboard merged from the stored partials alone; ``schemas`` (of sums and bitmaps) read partials that may
    hold no file yet."""
    _, days_path, bits_path = _paths(root)
    month = F.trunc("snapshot_date", "month").alias("month")
    read_sums, read_bits = (spark.read.schema(s) for s in schemas) if schemas else (spark.read, spark.read)
    sums = read_sums.parquet(days_path).groupBy(month).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("spend").alias("total_spend"), F.sum("leads").alias("total_leads"),
        F.sum("clicks").alias("total_clicks"),
        F.try_divide(F.sum("cpl_sum"), F.sum("cpl_n")).alias("avg_cpl"),
        F.try_divide(F.sum("cpc_sum"), F.sum("cpc_n")).alias("avg_cpc"),
        *[F.sum(n).alias(n) for n in TIER_NAMES.values()],
        F.max("last_updated").alias("last_updated"),
    ).where("n_rows > 0")
    distinct = (read_bits.parquet(bits_path).where(F.col("bitmap").isNotNull()).groupBy(month, "bucket")
                .agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
                .groupBy("month").agg(F.sum("n").alias("total_campaigns")))
    out = sums.join(distinct, "month", "left")
    return out.select(
        "month", F.coalesce("total_campaigns", F.lit(0)).cast("long").alias("total_campaigns"), "total_spend",
        "total_leads", "total_clicks", "avg_cpl", "avg_cpc", *TIER_NAMES.values(),
        F.when(F.col("total_clicks") > 0, ratio("total_leads", "total_clicks")).alias("overall_conversion_rate"),
        F.when(F.col("total_leads") > 0, ratio("total_spend", "total_leads")).alias("blended_cpl"),
        "last_updated",
    )
