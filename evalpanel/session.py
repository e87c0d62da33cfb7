"""Session helpers: a local session for tests, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "evalpanel") -> SparkSession:
    """A local session; on a cluster the session comes from the caller."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("EVALPANEL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and continue from there.

    Uses the shared folder named by ``spark.checkpoint.dir``; only a local session without that
    setting gets a scratch folder of its own.
    """
    spark = df.sparkSession
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not ctx.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        ctx.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)
