"""Sinks: CSV and BI extracts, keyed writes, event fan-out, versioned content.

Writes by key go to a new version of a table (a new folder) and never rewrite what they read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import constants as K
from sightline.functions import json_text as J
from sightline.operators.metrics import between
from sightline.operators.skew import ordinal
from sightline.session import shared_table

C = F.col
BOM = "\ufeff"


# --- CSV --------------------------------------------------------------------------------------------


class ExporterRegistry:
    """Entity -> (table builder, allowed columns, default columns, time column)."""

    def __init__(self) -> None:
        self._entities: dict[str, tuple[Callable[[], DataFrame], list[str], list[str], str]] = {}

    def register(self, entity: str, build: Callable[[], DataFrame], allowed: list[str], default: list[str], time: str) -> None:
        if entity in self._entities:
            raise ValueError(f"exporter {entity!r} is already registered")
        self._entities[entity] = (build, allowed, default, time)

    def export(
        self, entity: str, columns: list[str] | None = None, start: datetime | None = None, end: datetime | None = None
    ) -> DataFrame:
        """The rows of an export as text columns, checked against the allowed columns. No row cap."""
        if entity not in self._entities:
            raise ValueError(f"unknown entity {entity!r}")
        build, allowed, default, time = self._entities[entity]
        wanted = columns or default
        unknown = [c for c in wanted if c not in allowed]
        if unknown:
            raise ValueError(f"unknown columns for {entity}: {', '.join(unknown)}")
        rows = between(build(), time, start, end)
        return rows.select(*[csv_text(rows, c).alias(c) for c in wanted])


def csv_text(df: DataFrame, name: str) -> Column:
    """ISO times in UTC, JSON for nested values, plain text for the rest; null stays null (an empty cell)."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(name)
    return C(name).cast("string")


def csv_cell(x: Column) -> Column:
    """A cell of a CSV line: quoted only where it must be, quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.isNull(), F.lit("")).when(x.rlike('[,"\\n\\r]'), quoted).otherwise(x)


def csv_lines(df: DataFrame) -> DataFrame:
    """The rows of an export (text columns) as CSV lines."""
    return df.select(F.concat_ws(",", *[csv_cell(C(c)) for c in df.columns]).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Write CSV lines in parallel, ended by CRLF, and the header with the byte-order mark as a file of its own.

    The header part sorts before the data parts, so joining the files in name order gives one valid CSV.
    """
    spark = df.sparkSession
    csv_lines(df).write.mode("errorifexists").option("lineSep", "\r\n").text(f"{path}/part=1")
    header = BOM + ",".join(f'"{c}"' if any(x in c for x in ',"\n\r') else c for c in df.columns)
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("errorifexists").option(
        "lineSep", "\r\n").text(f"{path}/part=0")


# --- BI extract ---------------------------------------------------------------------------------------


def bi_extract(scans: DataFrame, counts: dict[str, tuple[DataFrame, str]], fields: list[str] | None = None) -> DataFrame:
    """Flat rows of the BI connector: dimensions and metrics per scan, dates as YYYYMMDD.

    ``scans`` (scan_id, domain, scanned_at, locale, status, score, readiness_level, and optionally
    competitor_domain); ``counts`` maps a COUNT metric to (table, scan or domain key). Unknown fields raise before
    any job runs.
    """
    wanted = fields or [f for f, spec in K.BI_FIELDS.items() if spec[4]]
    unknown = [f for f in wanted if f not in K.BI_FIELDS]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    rows = scans
    for metric in wanted:
        if K.BI_FIELDS[metric][3] == "COUNT":
            table, key = counts[metric]
            n = table.groupBy(key).agg(F.count(F.lit(1)).alias(metric))
            rows = rows.join(n, key, "left").withColumn(metric, F.coalesce(metric, F.lit(0)))
    computed = {
        "scan_date": F.date_format("scanned_at", "yyyyMMdd"),
        "locale_country": F.split_part(C("locale"), F.lit("-"), F.lit(2)),
        "locale_language": F.split_part(C("locale"), F.lit("-"), F.lit(1)),
        "readiness_score": C("score"),
    }
    return rows.select(*[(computed.get(f, C(f))).alias(f) for f in wanted])


def bi_schema(fields: list[str]) -> list[dict]:
    """Declared kind, type and default aggregation of the requested fields."""
    return [dict(zip(("id", "kind", "dataType", "aggregation"), (f, *K.BI_FIELDS[f][:2], K.BI_FIELDS[f][3]))) for f in fields]


# --- keyed writes ---------------------------------------------------------------------------------------


def insert_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a batch to append: the first per key that the target does not have yet."""
    payload = F.struct(*[C(c) for c in batch.columns if c not in keys])
    first = batch.groupBy(*keys).agg(F.min_by(payload, F.struct(*[C(c) for c in order])).alias("_row")).select(*keys, "_row.*")
    return first.join(target.select(*keys), keys, "left_anti").select(*batch.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """New version of a table: batch values overwrite, except columns in ``keep``, whose old value stays unless null.

    ``batch`` has one row per key.
    """
    values = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*values).alias("_old"))
    new = batch.select(*keys, F.struct(*values).alias("_new"))
    j = old.join(new, keys, "full_outer")

    def pick(c: str) -> Column:
        before, after = C(f"_old.{c}"), C(f"_new.{c}")
        if c in keep:
            return F.coalesce(before, after)
        return F.when(C("_new").isNotNull(), after).otherwise(before)

    return j.select(*keys, *[pick(c).alias(c) for c in values])


#: partitions of a keyed table
KEY_PARTITIONS = 64


def _key_partition(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("key_part")


def write_keyed(df: DataFrame, path: str, keys: list[str], parts: int = KEY_PARTITIONS) -> None:
    """A new table, partitioned by a hash of its keys, for ``upsert_keyed``."""
    df.withColumn("key_part", _key_partition(keys, parts)).repartition("key_part").write.partitionBy("key_part").parquet(path)


def upsert_keyed(path: str, batch: DataFrame, keys: list[str], keep: tuple[str, ...] = (), parts: int = KEY_PARTITIONS) -> list[int]:
    """``upsert`` of a batch into a table of ``write_keyed``; returns the partitions written.

    Only partitions that hold a key of the batch are read, and dynamic partition overwrite replaces those alone. The new rows are written
    aside first, so nothing is read from where it is replaced; a batch that runs again gives the same rows.
    """
    spark = batch.sparkSession
    touched = sorted(r[0] for r in batch.select(_key_partition(keys, parts)).distinct().collect())  # at most ``parts`` numbers
    if not touched:
        return []
    old = spark.read.parquet(path).filter(C("key_part").isin(touched)).drop("key_part")
    new = shared_table(upsert(old, batch, keys, keep).withColumn("key_part", _key_partition(keys, parts)), "upsert")
    out = new.repartition("key_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("key_part").parquet(path)
    return touched


def merge_json(target: DataFrame, patches: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Merge JSON objects per key, later patches winning, and count the keys of the result.

    ``target`` (key, doc), ``patches`` (key, patch, order columns). The last value per (key, field) is found first,
    so a key with many patches does not collect them.
    """
    parse = lambda c: F.from_json(C(c), "map<string,string>")
    base = target.select(key, F.explode_outer(parse("doc")).alias("field", "value"), *[F.lit(None).cast(patches.schema[o].dataType).alias(o) for o in order])
    changes = patches.select(key, F.explode(parse("patch")).alias("field", "value"), *order)
    last = base.filter(C("field").isNotNull()).unionByName(changes).groupBy(key, "field").agg(
        F.max_by(F.struct("value"), F.struct(*[C(o) for o in order])).alias("v"))
    docs = last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", C("v.value").alias("value"))))).alias("m"))
    return docs.select(key, F.to_json("m").alias("doc"), F.size("m").alias("field_count"))


# --- events and content -----------------------------------------------------------------------------------


def fan_out(events: DataFrame, endpoints: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One delivery row per event and active endpoint subscribed to its type, with the JSON envelope.

    ``events`` (event_id, event_type, created_at, data JSON text), ``endpoints`` (endpoint_id, events array,
    is_active). The subscription list is exploded, so this is an equi-join on the type, and on the columns of
    ``scope`` that both sides have: without a scope each event goes to all endpoints of its type.
    """
    subscribed = endpoints.filter("is_active").select("endpoint_id", *scope, F.explode(F.array_distinct("events")).alias("event_type"))
    envelope = F.to_json(F.struct(
        C("event_id").cast("string").alias("id"), C("event_type").alias("type"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt"), F.parse_json("data").alias("data")))
    return events.join(subscribed, ["event_type", *scope]).select(
        "event_id", "endpoint_id", "event_type", envelope.alias("payload"), F.lit("pending").alias("status"))


def content_hash(content: Column) -> Column:
    """SHA-256 of JSON in canonical text, or of the text itself."""
    return F.sha2(F.coalesce(J.canonical_json(content), content), 256)


def next_versions(store: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append to a versioned store: unchanged content is skipped, versions go on from the stored maximum.

    ``store`` (keys, version, content_hash, input_hash), ``batch`` (keys, content, input_hash, order columns).
    A row is skipped if its content hash or its input hash is stored for its key.
    """
    hashed = batch.withColumn("content_hash", content_hash(C("content")))
    fresh = hashed.join(store.select(*keys, "content_hash").distinct(), [*keys, "content_hash"], "left_anti")
    fresh = fresh.join(store.select(*keys, "input_hash").distinct(), [*keys, "input_hash"], "left_anti")
    once = insert_absent(store.limit(0), fresh, [*keys, "content_hash"], order)
    top = store.groupBy(*keys).agg(F.max("version").alias("_top"))
    # a batch brings few rows per key, so one bucket numbers them
    numbered = ordinal(once, keys, order, "_n", bucket=F.lit(0))
    return numbered.join(top, keys, "left").withColumn("version", F.coalesce("_top", F.lit(0)) + C("_n")).drop("_top", "_n")
