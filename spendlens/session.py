"""Session helpers for tests, the bench and stand-alone runs. Cluster jobs bring their own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# Recommended runtime settings. The scoring expressions compile to long methods; beyond 8000 bytes of bytecode the
# JVM never JIT-compiles a method, so whole-stage fusion of them runs several times slower than separate projections.
RUNTIME_CONF = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings that the session has not set itself."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) in (None, "65535"):
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "spendlens", cores: str | None = None) -> SparkSession:
    """A local session with the settings the library is tuned for."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPENDLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        # A local run shares one machine, so a folder of it serves driver and executors alike.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-shared-"))
    return tune(spark)
