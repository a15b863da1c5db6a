"""Per-key operators that stay distributed when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. The helpers here either aggregate
before the shuffle, or split a key into time buckets, work inside each bucket, and carry the small
per-bucket summaries across.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """The last (or first) row per key by ``order``. Map-side aggregation; nulls in ``order`` come lowest."""
    payload = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    rank = F.struct(*[F.col(c) for c in order])
    pick = F.min_by(payload, rank) if first else F.max_by(payload, rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key with their rank.

    Spark keeps only ``k`` rows per key and partition before the shuffle (WindowGroupLimit), so a hot
    key reaches its final task with at most ``k`` rows per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _bucket(df: DataFrame, order: list[str], bucket: Column | None) -> DataFrame:
    return df.withColumn("_bucket", F.date_trunc("day", F.col(order[0])) if bucket is None else bucket)


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "previous_", bucket: Column | None = None
) -> DataFrame:
    """Add the values of the row before, per key and ``order``, as ``previous_*`` (null on the first row).

    ``bucket`` must grow with ``order`` (default: the day of the first order column). Rows are sorted per (key,
    bucket) only; the first row of a bucket takes the last row of the bucket before it. Null keys form a key.
    """
    rows = _bucket(df, order, bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    payload = F.struct(*[F.col(c) for c in columns])
    rows = rows.withColumn("_previous", F.lag(payload).over(inner))

    ends = _bucket(df, order, bucket).groupBy(*keys, "_bucket").agg(
        F.max_by(payload, F.struct(*[F.col(c) for c in order])).alias("_last")
    )
    chain = Window.partitionBy(*keys).orderBy("_bucket")
    carried = ends.select(*keys, "_bucket", F.lag("_last").over(chain).alias("_carried"))
    joined = rows.join(_null_safe(carried, keys + ["_bucket"]), _on(rows, keys + ["_bucket"]), "left")
    before = F.coalesce("_previous", "_carried")
    return joined.select(*df.columns, *[before.getField(c).alias(prefix + c) for c in columns])


def previous_values(
    df: DataFrame, keys: list[str], order: list[str], column: str, n: int, name: str = "previous", bucket: Column | None = None
) -> DataFrame:
    """Add the values of the up to ``n`` rows before, newest first, per key and ``order``.

    As ``previous_row``, in one pass: each bucket hands on its last ``n`` values, and a row looks back over at most
    ``n`` buckets, as each has at least one row.
    """
    rows = _bucket(df, order, bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    item = F.struct(F.col(column).alias("v"))
    near = F.filter(F.array(*[F.lag(item, i).over(inner) for i in range(1, n + 1)]), lambda x: x.isNotNull())
    rows = rows.withColumn("_near", near)

    tail = _bucket(df, order, bucket).select(*dict.fromkeys([*keys, "_bucket", *order, column]))
    tail = top_k_per_key(tail, [*keys, "_bucket"], [F.desc(c) for c in order], n, "_rank")
    ends = tail.groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_list(F.struct("_rank", F.col(column).alias("v")))).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(1, n)
    carried = ends.select(*keys, "_bucket", F.flatten(F.collect_list("_tail").over(earlier)).alias("_carried"))
    joined = rows.join(_null_safe(carried, keys + ["_bucket"]), _on(rows, keys + ["_bucket"]), "left")
    values = lambda c: F.transform(c, lambda x: x["v"])
    return joined.select(*df.columns, F.slice(F.concat(values("_near"), values("_carried")), 1, n).alias(name))


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal", bucket: Column | None = None) -> DataFrame:
    """Add the 1-based position of each row within its key, numbering bucket by bucket."""
    rows = _bucket(df, order, bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(inner))
    sizes = _bucket(df, order, bucket).groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    chain = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(chain), F.lit(0)).alias("_before"))
    joined = rows.join(_null_safe(offsets, keys + ["_bucket"]), _on(rows, keys + ["_bucket"]), "left")
    return joined.select(*df.columns, (F.col("_before") + F.col("_n")).alias(name))


def _null_safe(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias("_r_" + c) if c in names else F.col(c) for c in df.columns])


def _on(left: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(F.col("_r_" + n)) for n in names])

