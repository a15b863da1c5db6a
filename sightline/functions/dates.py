"""Date helpers. Every truncation is in the session time zone, which is pinned to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed list of accepted date texts; anything else is no date.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]",
    "yyyy-MM-dd'T'HH:mmXXX",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "yyyy-MM",
    "yyyy",
)


def parse_date(text: Column) -> Column:
    """Timestamp of a free-form date text, null outside the years 1990 to 2100."""
    t = F.btrim(text)
    ts = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS])
    return F.when(F.year(ts).between(1990, 2100), ts)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def days_between(a: Column, b: Column) -> Column:
    """Distance in days, with fractions."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400_000_000.0)


def step(frequency: Column) -> Column:
    """Cadence of a schedule in hours; unknown names count as daily."""
    return F.when(frequency == "hourly", 1).when(frequency == "weekly", 168).otherwise(24)
