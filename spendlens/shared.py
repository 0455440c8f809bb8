"""Results written once to the folder that driver and executors share, so that later steps don't compute them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint
    folder of the context (``local_session`` sets one for local runs). Without either the job stops with an error
    that names the setting; no machine-local folder is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back. The cluster's clean-up of that folder removes what is no
    longer read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
