"""URL parts and canonical forms as Column expressions.

``parse_url`` follows java.net.URI and rejects many URLs found in text, so the parts are read with
regular expressions instead; anything that is not http(s) with a host gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.text import trim_ws

_HTTP = r"(?i)^https?://[^\s/?#]+"


def _part(url: Column, pattern: str) -> Column:
    return F.when(url.rlike(_HTTP), F.regexp_extract(url, pattern, 1))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, r"^([A-Za-z]+)://"))


def host(url: Column) -> Column:
    return F.lower(_part(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)"))


def bare_host(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def authority(url: Column) -> Column:
    """Host with port, without the default port of the scheme."""
    raw = F.lower(_part(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]+)"))
    return F.when(scheme(url) == "http", F.regexp_replace(raw, ":80$", "")).otherwise(
        F.regexp_replace(raw, ":443$", "")
    )


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path(url: Column) -> Column:
    """Path, ``/`` when empty; characters outside ASCII are percent-encoded."""
    raw = _part(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)")
    return F.when(raw == "", F.lit("/")).otherwise(_encode(raw))


def _encode(raw: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(raw, ""),
            lambda c: F.when(c == " ", F.lit("%20")).when(c.rlike(r"^[\x21-\x7e]?$"), c).otherwise(F.url_encode(c)),
        ),
        "",
    )
    return F.when(raw.rlike(r"^[\x21-\x7e]*$"), raw).otherwise(encoded)


def query(url: Column) -> Column:
    return _part(url, r"^[^?#]*\?([^#]*)")


def query_pairs(url: Column) -> Column:
    """``key=value`` pairs in order, empty ones dropped, ``=`` added where missing."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))


def _without_keys(pairs: Column, pattern: str) -> Column:
    return F.filter(pairs, lambda p: ~F.split_part(p, F.lit("="), F.lit(1)).rlike(pattern))


def canonical(url: Column) -> Column:
    """Canonical form for citations: lower-case host, no fragment, no tracking keys; ``www.`` stays.

    Null if the text is not an http(s) URL. A bare root path without query loses its slash.
    """
    u = trim_ws(url)
    q = F.array_join(_without_keys(query_pairs(u), K.TRACKING_KEYS_STRICT), "&")
    p = path(u)
    return F.concat(
        origin(u),
        F.when((p == "/") & (q == ""), F.lit("")).otherwise(p),
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
    )


def normalize(
    url: Column,
    strip_fragment: bool = True,
    strip_tracking: bool = True,
    strip_query: bool = False,
    strip_www: bool = True,
    strip_trailing_slash: bool = True,
) -> Column:
    """Option-driven canonical form for matching; text that is no URL comes back unchanged."""
    site = F.concat(
        scheme(url), F.lit("://"),
        F.regexp_replace(authority(url), r"^www\.", "") if strip_www else authority(url),
    )
    p = path(url)
    if strip_trailing_slash:
        p = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
    raw = query(url)
    if strip_query:
        q = F.lit("")
    elif strip_tracking:
        kept = _without_keys(query_pairs(url), K.TRACKING_KEYS_PREFIX)
        q = F.when(F.size(kept) == F.size(query_pairs(url)), raw).otherwise(F.array_join(kept, "&"))
    else:
        q = raw
    out = F.concat(site, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    if not strip_fragment:
        fragment = F.regexp_extract(url, r"(#.*)$", 1)
        out = F.concat(out, F.when(fragment == "#", F.lit("")).otherwise(fragment))
    return F.coalesce(out, url)


def match_path(url: Column) -> Column:
    """Path without a trailing slash (root stays ``/``), the form the match cascade compares."""
    p = F.regexp_replace(path(url), "/$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def _remove_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.substring(p, 2, 1_000_000_000), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    slash = F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), slash)
    return F.when(p.rlike(r"/\.\.?(/|$)"), F.regexp_replace(joined, "^/+", "/")).otherwise(p)


def resolve(ref: Column, base: Column) -> Column:
    """Resolve a possibly relative reference against an http(s) base; the fragment is dropped.

    Null when the base is no URL or the reference has another scheme.
    """
    r = F.regexp_replace(trim_ws(ref), "#.*$", "")
    tail = F.regexp_extract(r, r"^([^?]*)", 1)
    q = F.regexp_extract(r, r"(\?.*)$", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    base_query = query(base)
    absolute = F.concat(origin(r), _remove_dots(path(r)), F.regexp_extract(r, r"(\?.*)$", 1))
    return (
        F.when(r.rlike(_HTTP), absolute)
        .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(r.startswith("//"), F.concat(scheme(base), F.lit(":"), r))
        .when(r.startswith("/"), F.concat(origin(base), _remove_dots(_encode(tail)), q))
        .when(tail != "", F.concat(origin(base), _remove_dots(_encode(F.concat(folder, tail))), q))
        .when(q != "", F.concat(origin(base), path(base), q))
        .otherwise(
            F.concat(
                origin(base), path(base),
                F.when(base_query != "", F.concat(F.lit("?"), base_query)).otherwise(F.lit("")),
            )
        )
    )
