"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_items(df: DataFrame, columns: list, items: Column | str, name: str, position: str | None = None) -> DataFrame:
    """One row per array member, none for empty arrays.

    A plain ``explode`` makes the optimizer add a filter on the size of the array, and pushing it down repeats the
    whole expression behind the array, inside every lambda. The outer form with a test on the member avoids that.
    """
    generator = F.posexplode_outer(items).alias(position, name) if position else F.explode_outer(items).alias(name)
    return df.select(*columns, generator).filter(F.col(name).isNotNull())
