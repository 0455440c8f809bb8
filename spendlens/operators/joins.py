"""Join patterns that hold up on skewed keys and on sides whose size is not known in advance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_lookup(
    left: DataFrame,
    lookup: DataFrame,
    key: str,
    hot_keys: Sequence,
    spread_by: Sequence[str],
    salts: int = 32,
) -> DataFrame:
    """Left join to a lookup with one row per key, spreading the rows of ``hot_keys`` over ``salts`` tasks.

    The hot list only steers the spread. Every row finds its key whether or not it is on the list.
    """
    if not hot_keys:
        return left.join(lookup, key, "left")
    hot = F.col(key).isin(*hot_keys)
    salt = F.when(hot, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return (
        left.withColumn("_salt", salt)
        .join(lookup.withColumn("_salt", F.explode(copies)), [key, "_salt"], "left")
        .drop("_salt")
    )


def latest_only(df: DataFrame, order_col: str) -> DataFrame:
    """Rows of the newest snapshot."""
    newest = df.agg(F.max(order_col).alias(order_col))
    return df.join(newest, order_col, "left_semi")


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Spark trims each map task to one row per key before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their position; map tasks keep at most ``n`` rows per key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
