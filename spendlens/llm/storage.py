"""Tables kept between jobs in the folder that driver and executors share, and what Python tasks need."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast: 2 million longs are 16 MB. Beyond it Spark's own join is used.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's checkpoint folder (a local session sets one). Without
    either the job stops with an error that names the setting; no machine-local folder is made."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df to the shared folder and read it back: work done once, its lineage cut, safe against lost executors.
    options are those of the writer."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> int:
    """Let Python workers import this package; the number of shuffle partitions."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if they are few; `ids` must be a saved table, so that counting reads only file footers."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def unused(df: DataFrame, name: str) -> str:
    """name, or with signs appended one that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
