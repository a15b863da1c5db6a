"""Tolerant JSON reading over text columns, without a fixed schema.

A JSON object is read as ``MAP<STRING, STRING>`` whose values are plain strings or raw JSON text, so
values that may be a string or an array stay readable.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
OBJECT = "map<string,string>"


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def as_object(text: Column) -> Column:
    """Top-level keys of a JSON object, null for anything else."""
    return F.when(text.rlike(r"^\s*\{"), F.from_json(text, OBJECT, _STRICT))


def as_objects(text: Column) -> Column:
    """The objects in a JSON array; other members are dropped."""
    raw = F.from_json(text, "array<string>", _STRICT)
    return F.when(
        text.rlike(r"^\s*\["),
        F.transform(F.filter(raw, lambda x: x.rlike(r"^\s*\{")), lambda x: F.from_json(x, OBJECT, _STRICT)),
    )


def string_list(value: Column) -> Column:
    """A value that is a string or an array of strings, as an array."""
    return (
        F.when(value.isNull(), F.array().cast("array<string>"))
        .when(value.rlike(r"^\s*\["), F.from_json(value, "array<string>", _STRICT))
        .otherwise(F.array(value))
    )


def canonical_json(text: Column) -> Column:
    """JSON text without insignificant white space, for equality tests and hashes."""
    return F.to_json(F.try_parse_json(text))


def mask_keys(text: Column, keys: tuple[str, ...], mark: str = "[REDACTED]") -> Column:
    """Replace the values of the given keys (case ignored), whatever they hold, at any depth of a JSON text.

    The text is parsed and written again without insignificant white space, so that the result is always valid. A text that
    is no JSON, or nested too deeply to be read, is replaced as a whole.
    """
    wanted = frozenset(k.lower() for k in keys)

    def masked(value):
        if isinstance(value, dict):
            return {k: mark if k.lower() in wanted else masked(v) for k, v in value.items()}
        return [masked(v) for v in value] if isinstance(value, list) else value

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            try:
                out.append(None if x is None else json.dumps(masked(json.loads(x)), ensure_ascii=False, separators=(",", ":")))
            except (ValueError, RecursionError):
                out.append(json.dumps(mark))
        return pa.array(out, pa.string())

    return run(text)


def base64url(value: Column) -> Column:
    return F.rtrim(F.translate(F.base64(value), "+/\n\r", "-_"), F.lit("="))
