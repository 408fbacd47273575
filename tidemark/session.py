"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Scratch folders of this process.
_MADE: list[str] = []

# Runtime re-planning does the size-checked work: it turns a join into a
# broadcast only when the finished map stage is below the threshold, splits
# skewed partitions, and merges small ones.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the plans are designed for."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = "*", memory: str = "16g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture per column expression makes wide plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediates: spark.checkpoint.dir, else below the warehouse.

    Both are named by the session and seen by the driver and all executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared root, deleted when the driver process ends."""
    path = os.path.join(scratch_root(spark), f"tidemark-{label}-{uuid.uuid4().hex}")
    if not _MADE:
        atexit.register(_delete_made)
    _MADE.append(path)
    return path


def _delete_made() -> None:
    """Delete the folders handed out, while a session is still there to do it."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in _MADE:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to a fresh scratch folder and read it back: cuts lineage and
    survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
