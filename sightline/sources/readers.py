"""Readers for stored tables. Schemas are explicit; filters stay declarative so that they reach the scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schemas


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored table with its declared schema (``parquet``, ``json``, ``orc`` or ``csv``)."""
    return spark.read.schema(schemas.schema(name)).format(fmt).load(path)


def read_answers(
    spark: SparkSession, path: str, project_id: int | None = None, start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """AI answers of a project and period. The table is partitioned by ``day``, which prunes the scan."""
    df = read_table(spark, "answers", path)
    if start is not None:
        df = df.filter((F.col("day") >= F.lit(start.date())) & (F.col("queried_at") >= F.lit(start)))
    if end is not None:
        df = df.filter((F.col("day") <= F.lit(end.date())) & (F.col("queried_at") <= F.lit(end)))
    if project_id is not None:
        df = df.filter(F.col("project_id") == project_id)
    return df


def answers_of_days(answers: DataFrame, days: DataFrame) -> DataFrame:
    """The answers of wanted (project_id, day) rows. ``day`` partitions the answers, and the join itself prunes them: only the days
    that ``days`` has left after its own filters are listed and read."""
    wanted = days.select("project_id", "day").distinct()
    return answers.join(wanted, ["project_id", "day"])


def spread(df: DataFrame) -> DataFrame:
    """Split a scan with fewer input partitions than cores, before per-row work. A large table is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
