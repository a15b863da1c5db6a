"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that are right on one machine and on a large cluster alike. The number of shuffle
# partitions is only a starting point: adaptive execution merges small partitions and splits
# skewed ones, so on a cluster it should be set high (e.g. 2-3x the executor cores).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a Python worker holds a batch and all that is made of it, so batches of long texts must have few rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # recording the call site of every Column call triples the time to build large plans
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "sightline", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIGHTLINE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Set the run-time settings that results (time zone, map merge policy) and the memory of Python workers depend on."""
    for key in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(key, BASE_CONF[key])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for lineage cuts: the cluster's setting. Only a session on one machine
    (tests, bench) gets a temporary one; elsewhere it would be lost with its executor."""
    existing = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if existing is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        existing = tempfile.mkdtemp(prefix="sightline-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(existing)
    return existing


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a new table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/sightline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, if it is not installed there."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_sightline_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = tempfile.mkdtemp(prefix="sightline-ship-")
    archive = shutil.make_archive(os.path.join(target, "sightline"), "zip", root_dir=root, base_dir="sightline")
    sc.addPyFile(archive)
    sc._sightline_shipped = True
