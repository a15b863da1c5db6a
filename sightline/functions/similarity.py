"""String similarity as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_USED = "\ue001"


def within_edits(a: Column, b: Column, cap: int | Column) -> Column:
    """True if the edit distance is at most ``cap``. The cheap length test comes first."""
    return (F.abs(F.length(a) - F.length(b)) <= cap) & (F.levenshtein(a, b) <= cap)


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity: characters shared within half the longer length, less half the transpositions.

    Characters of ``b`` that found a partner are overwritten, so that each is used once. Meant for short strings
    that passed a cheaper test.
    """
    reach = F.greatest(F.lit(0), F.floor(F.greatest(F.length(a), F.length(b)) / 2) - 1).cast("int")
    state = "struct<rest:string,left:string,i:int>"
    zero = F.struct(b.alias("rest"), F.lit("").alias("left"), F.lit(0).alias("i")).cast(state)

    def take(s: Column, ch: Column) -> Column:
        low = F.greatest(F.lit(0), s["i"] - reach)
        at = F.instr(F.substring(s["rest"], low + 1, s["i"] + reach + 1 - low), ch)
        hit = at > 0
        return F.struct(
            F.when(hit, F.overlay(s["rest"], F.lit(_USED), low + at, F.lit(1))).otherwise(s["rest"]).alias("rest"),
            F.when(hit, F.concat(s["left"], ch)).otherwise(s["left"]).alias("left"),
            (s["i"] + 1).alias("i"),
        ).cast(state)

    def finish(s: Column) -> Column:
        left = F.split(s["left"], "")
        right = F.filter(
            F.zip_with(F.split(b, ""), F.split(s["rest"], ""), lambda x, y: F.when(y == _USED, x)), lambda x: x.isNotNull()
        )
        m = F.length(s["left"])
        swaps = F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d)) / 2
        score = (m / F.length(a) + m / F.length(b) + (m - swaps) / m) / 3
        return F.when(m > 0, score).otherwise(0.0)

    folded = F.aggregate(F.split(a, ""), zero, take, finish)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(folded)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro raised by a tenth of the gap for each of up to four shared leading characters."""
    same = lambda n: (F.substring(a, 1, n) == F.substring(b, 1, n)) & (F.length(a) >= n) & (F.length(b) >= n)
    prefix = F.when(same(4), 4).when(same(3), 3).when(same(2), 2).when(same(1), 1).otherwise(0)
    # base + prefix / 10 * (1 - base), with the large base expression written once
    return jaro(a, b) * (1 - prefix * 0.1) + prefix * 0.1
