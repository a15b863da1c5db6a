"""Text helpers built from JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as web text has it. Java's \s is ASCII only, and (?U) would also widen \w and \b.
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_OTHER = f"[{WS_CHARS[1:]}]"  # all but the plain blank
WS = f"[{WS_CHARS}]"
URL = r"https?://[^\s)\]>\"']+"
# One private-use character stands for each character of a URL, so that offsets stay the same.
MASK = ""
_IN_URL = r"(?:(?=https?://[^\s)\]>\"'])|(?!^)\G(?<=[^\s)\]>\"']))[^\s)\]>\"']"


def java_quote(text: str) -> str:
    """A literal for a Java regular expression."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def trim_ws(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def squeeze_ws(x: Column) -> Column:
    """Collapse runs of white space to one blank and trim. A single plain blank is left alone, which is most of them."""
    return F.btrim(F.regexp_replace(x, f"{WS_OTHER}{WS}*| {WS}+", " "))


def contains_any(x: Column, phrases: tuple[str, ...]) -> Column:
    """True if any phrase occurs in ``x`` (already lower-cased where that is wanted)."""
    return x.rlike("|".join(java_quote(p) for p in phrases))


def count_present(x: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in ``x`` at least once."""
    total = F.lit(0)
    for word in words:
        total = total + x.contains(word).cast("int")
    return total


def mask_urls(x: Column) -> Column:
    """Replace every character inside an http(s) URL by a mask character; all offsets are kept."""
    return F.when(x.contains("://"), F.regexp_replace(x, _IN_URL, MASK)).otherwise(x)


def whole_word(name: Column) -> Column:
    """A Java pattern for a name as a whole word; names over two characters ignore case."""
    quoted = F.regexp_replace(name, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.concat(
        F.when(F.length(name) > 2, F.lit("(?iu)")).otherwise(F.lit("")),
        F.lit(rf"(?<![\w{MASK}])"), quoted, F.lit(rf"(?![\w{MASK}])"),
    )


def lines(x: Column) -> Column:
    return F.split(F.regexp_replace(x, "\r\n|\r", "\n"), "\n")


def context_window(text: Column, offset: Column, length: Column, chars: int) -> Column:
    """The text from ``chars`` before to ``chars`` after a match (0-based offset), trimmed."""
    start = F.greatest(F.lit(0), offset - chars)
    return trim_ws(F.substring(text, start + 1, offset + length + chars - start))


def email_domain(x: Column) -> Column:
    return F.split_part(F.lower(x), F.lit("@"), F.lit(2))
