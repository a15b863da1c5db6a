"""Rounding and ratio helpers. Halves round up (towards +infinity), as the scores require."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Round halves up: -2.5 -> -2. Spark's own ``round`` would give -3."""
    if digits == 0:
        return F.floor(x + F.lit(0.5))
    factor = F.lit(float(10**digits))
    return F.floor(x * factor + F.lit(0.5)) / factor


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def percent_change(before: Column, after: Column, digits: int) -> Column:
    """Change in percent of ``before``; null when ``before`` is 0 or either side is null."""
    return F.when(before != 0, round_half_up((after - before) * 100.0 / before, digits))


def direction(delta: Column, up: str = "improved", down: str = "regressed", same: str = "unchanged") -> Column:
    """Label the sign of ``delta``; a null delta counts as unchanged."""
    return F.when(delta > 0, up).when(delta < 0, down).otherwise(same)


def steps(x: Column, *ladder: tuple[float, int]) -> Column:
    """Points of the first rung reached: ``steps(x, (5, 8), (3, 5))`` is 8 from 5 up, 5 from 3 up, else 0."""
    out = F.lit(0)
    for floor, points in reversed(ladder):
        out = F.when(x >= floor, points).otherwise(out)
    return out


def steps_down(x: Column, *ladder: tuple[float, int]) -> Column:
    """Points of the first ceiling not exceeded: ``steps_down(x, (90, 30), (365, 22))``."""
    out = F.lit(0)
    for ceiling, points in reversed(ladder):
        out = F.when(x <= ceiling, points).otherwise(out)
    return out


def points(condition: Column, value: int | Column, otherwise: int | Column = 0) -> Column:
    return F.when(condition, value).otherwise(otherwise)
