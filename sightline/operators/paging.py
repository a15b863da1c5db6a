"""Ordered pages, cursors and list requests."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.skew import latest_per_key

C = F.col
# --- cursor codec: one value on the driver ---------------------------------------------------------


def encode_cursor(time: str, row_id: int | str, key: bytes = b"") -> str:
    """Opaque token of a keyset position; with a key it carries a tag that shows tampering."""
    body = base64.urlsafe_b64encode(json.dumps({"t": time, "id": row_id}, separators=(",", ":")).encode()).rstrip(b"=")
    if not key:
        return body.decode()
    tag = base64.urlsafe_b64encode(hmac.new(key, body, hashlib.sha256).digest()).rstrip(b"=")
    return f"{body.decode()}.{tag.decode()}"


def decode_cursor(token: str, key: bytes = b"") -> tuple[str, int | str]:
    body, _, tag = token.partition(".")
    if key and not hmac.compare_digest(encode_cursor(*_open(body), key=key), token):
        raise ValueError("cursor tag does not match")
    if not key and tag:
        raise ValueError("unexpected cursor tag")
    return _open(body)


def _open(body: str) -> tuple[str, int | str]:
    try:
        data = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
        return data["t"], data["id"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("malformed cursor") from e


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC tag (hex) of a text column, from two SHA-256 passes."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


# --- pages -----------------------------------------------------------------------------------------


def keyset_page(df: DataFrame, time: str, row_id: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """``limit + 1`` rows after a (time, id) position, newest first; the extra row says that there are more.

    The plan is a top-k over a filtered scan, so deep pages cost the same as the first one.
    """
    if cursor is not None:
        t, i = F.lit(cursor[0]).cast(df.schema[time].dataType), F.lit(cursor[1]).cast(df.schema[row_id].dataType)
        df = df.filter((C(time) < t) | ((C(time) == t) & (C(row_id) < i)))
    return df.orderBy(F.desc(time), F.desc(row_id)).limit(limit + 1)


def sentiment_rank(x: Column) -> Column:
    return F.when(x == "positive", 1).when(x == "neutral", 2).when(x == "negative", 3).otherwise(4)


def mention_order(sort: str = "date", direction: str = "desc") -> list[Column]:
    """Order of a mention list; by date it is always newest first. Unknown engines come first when descending."""
    tail = [F.desc("mentioned_at"), F.desc("mention_id")]
    if sort == "sentiment":
        rank = sentiment_rank(C("sentiment"))
        return [rank.asc() if direction == "asc" else rank.desc(), *tail]
    if sort == "model":
        return [C("ai_engine").asc_nulls_last() if direction == "asc" else C("ai_engine").desc_nulls_first(), *tail]
    return tail


def offset_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def latest_per_locale(scans: DataFrame) -> DataFrame:
    return latest_per_key(scans, ["domain", "locale"], ["scanned_at", "scan_id"])


# --- list requests ---------------------------------------------------------------------------------


class RequestError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class ListRequest:
    limit: int
    fields: list[str] | None = None
    sort: tuple[str, str] | None = None
    cursor: str | None = None
    filters: dict[str, str] = field(default_factory=dict)


def parse_list_request(
    params: dict[str, str], fields: list[str], sortable: list[str], default_limit: int = 20, max_limit: int = 100
) -> ListRequest:
    """Validate request parameters; anything not reserved is an equality filter. Raises before any job runs."""
    raw = params.get("limit")
    try:
        limit = default_limit if raw is None else int(raw)
    except ValueError:
        limit = 0
    if limit < 1:
        raise RequestError("INVALID_LIMIT", "limit must be at least 1")
    wanted = [f.strip() for f in params.get("fields", "").split(",") if f.strip()] or None
    unknown = [f for f in wanted or [] if f not in fields]
    if unknown:
        raise RequestError("INVALID_FIELDS", f"unknown fields: {', '.join(unknown)}")
    sort = None
    if params.get("sort"):
        name = params["sort"].removeprefix("-")
        if name not in sortable:
            raise RequestError("INVALID_SORT", f"cannot sort by {name}")
        sort = (name, "desc" if params["sort"].startswith("-") else "asc")
    filters = {k: v for k, v in params.items() if k not in ("cursor", "limit", "fields", "sort")}
    bad = [k for k in filters if k not in fields]
    if bad:
        raise RequestError("INVALID_FILTER", f"unknown filters: {', '.join(bad)}")
    return ListRequest(min(max_limit, limit), wanted, sort, params.get("cursor"), filters)


def run_list_request(df: DataFrame, request: ListRequest, row_id: str) -> DataFrame:
    """Filtered, sorted and projected rows, one more than the limit."""
    for name, value in request.filters.items():
        df = df.filter(C(name).cast("string") == value)
    order = []
    if request.sort:
        name, direction = request.sort
        order.append(C(name).desc_nulls_first() if direction == "desc" else C(name).asc_nulls_last())
    df = df.orderBy(*order, F.asc(row_id)).limit(request.limit + 1)
    return df.select(*(request.fields or df.columns))
