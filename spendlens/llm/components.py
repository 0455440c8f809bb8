"""Connected components by alternating star contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in edges: component is the smallest id that links reach, in either direction.

    Each round points every larger neighbour of a node at the node's smallest neighbour, then every smaller one, so a
    chain of n links is done in about log(n) rounds. A node's neighbours are reduced with min and joined back, never
    gathered. Loops, repeated edges and null ends are allowed; nodes with only these don't appear.
    """
    u, v = F.col(a), F.col(b)
    pairs = edges.where(u.isNotNull() & v.isNotNull() & (u != v))
    pairs = saved(pairs.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    while pairs.head() is not None:
        both = pairs.union(pairs.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        low = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = saved(low.union(down.toDF("u", "v")).distinct(), "small-star")
        twice = pairs.groupBy("u").count().where("count > 1").select("u")
        chained = pairs.select(F.col("v").alias("u")).join(pairs.select("u"), "u", "left_semi")
        if twice.union(chained).head() is None:
            break
    roots = pairs.select("v", "v").distinct().toDF("id", "component")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
