"""Percent rank with average ties over a whole table, without a window that pulls it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .joins import salted_lookup

HOT_SALTS = 32


def _quantiles(df: DataFrame, value: str, parts: int) -> tuple[list[float], list[float]]:
    """Distinct cut points, and the values that fill more than one ``parts``-th of the rows.

    At most ``parts`` numbers reach the driver.
    """
    probs = [i / parts for i in range(1, parts)]
    cuts = df.stat.approxQuantile(value, probs, 1.0 / (4 * parts))
    hot = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    return sorted(set(cuts)), hot


def average_percent_rank(
    df: DataFrame,
    value: str,
    out: str,
    spread_by: Sequence[str],
    parts: int | None = None,
) -> DataFrame:
    """Add ``out`` = average rank of ``value`` divided by the row count, in (0, 1]. ``value`` must not be NULL.

    Rows are first counted per distinct value, so a value shared by a third of the table is one row from then
    on. Distinct values are cut into ranges at approximate quantiles; the running count inside a range plus
    the total of the ranges before it is the exact rank. The cuts only balance the work: being constants of
    the plan, they put equal values into the same range whenever a task is recomputed.

    Only the value column is written to the shared folder (one narrow table); cuts and counts read it, and the ranks
    per distinct value are joined back to df by value. The value is a deterministic expression, so df computes the same
    bits again. This write and the quantiles over its one column are the only jobs that run at once.
    """
    spark = df.sparkSession
    values = written(df.select(value), "to-rank")
    parts = parts or max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts, hot = _quantiles(values, value, parts)
    counts = values.groupBy(value).agg(F.count("*").alias("_n"))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        counts = Bucketizer(splits=splits, inputCol=value, outputCol="_range").transform(counts)
    else:
        counts = counts.withColumn("_range", F.lit(0.0))

    # One row per range (at most parts + 1 rows): the only place a single task sees everything.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        counts.groupBy("_range")
        .agg(F.sum("_n").alias("_total"))
        .select(
            "_range",
            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"),
            F.sum("_total").over(Window.partitionBy()).alias("_rows"),
        )
    )
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = (
        counts.withColumn("_upto", F.sum("_n").over(inside))
        .join(F.broadcast(ranges), "_range")
        .select(
            value,
            ((F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)) / F.col("_rows")).alias(out),
        )
    )
    return salted_lookup(df, ranks, value, hot, spread_by, HOT_SALTS)
