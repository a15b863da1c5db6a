"""Brand mentions in answer texts.

Everything is computed inside the row of an answer: the brand configuration (a few names and domains per
project) is joined on, matches are array expressions over the text, and only the final mentions are exploded.
No text is shuffled for matching and no Python runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import urls
from sightline.functions.arrays import explode_items
from sightline.functions.similarity import jaro_winkler
from sightline.functions.text import (
    MASK, URL, contains_any, context_window, count_present, mask_urls, trim_ws, whole_word,
)

C = F.col
MATCH = "struct<at:int,order:int,name_no:int,len:int,confidence:double,kind:string,text:string>"
MATCHES = f"array<{MATCH}>"
SPACED = r"\s,;:!?()\[\]{}\"'—–"  # what separates tokens
_TOKEN = rf"[{SPACED}{MASK}]*[^{SPACED}{MASK}]+"


def brand_config(names: DataFrame, domains: DataFrame, competitors: DataFrame | None = None) -> DataFrame:
    """One row per project: brand, its distinct names in order, own domains and competitor keywords.

    ``names`` (project_id, brand, name); ``domains`` (project_id, domain). These are settings a person enters, a
    handful per project.
    """
    out = names.filter(C("name") != "").groupBy("project_id").agg(
        F.min("brand").alias("brand"), F.array_sort(F.collect_set("name")).alias("names"))
    own = domains.groupBy("project_id").agg(F.array_sort(F.collect_set(
        F.regexp_replace(F.lower("domain"), r"^www\.", ""))).alias("domains"))
    out = out.join(own, "project_id", "left")
    if competitors is not None:
        keys = competitors.filter(C("keyword") != "").groupBy("project_id").agg(
            F.array_sort(F.collect_set("keyword")).alias("competitors"))
        out = out.join(keys, "project_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in out.columns if c in ("domains", "competitors")})


def _match(at: Column, kind: str, name_no: Column, length: Column, confidence: Column, text: Column) -> Column:
    order = list(K.MATCH_PRIORITY).index(kind)
    return F.struct(
        at.cast("int").alias("at"), F.lit(order).alias("order"), name_no.cast("int").alias("name_no"),
        length.cast("int").alias("len"), confidence.cast("double").alias("confidence"), F.lit(kind).alias("kind"),
        text.alias("text"),
    ).cast(MATCH)


def _no_matches() -> Column:
    return F.array().cast(MATCHES)


def offsets(text: Column, pattern: Column | str, lengths: Callable[[Column], Column]) -> Column:
    """0-based offsets of all matches: running length of the pieces between them plus the matches themselves.

    ``lengths(i)`` is the length of match ``i`` (1-based).
    """
    pieces = F.split(text, pattern)
    state = "struct<pos:int,n:int,out:array<int>>"
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(s: Column, piece: Column) -> Column:
        at = s["pos"] + F.length(piece)
        return F.struct(
            (at + lengths(s["n"] + 1)).alias("pos"), (s["n"] + 1).alias("n"), F.concat(s["out"], F.array(at)).alias("out")
        ).cast(state)

    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), zero, step, lambda s: s["out"])


# --- strategies: function(text, masked text, config columns) -> array of matches -----------------------


def exact_matches(df: DataFrame) -> Column:
    """Whole-word occurrences of each name outside URLs, confidence 1."""
    masked = C("_masked")
    per_name = F.transform(
        "names",
        lambda name, no: F.when(
            F.lower(masked).contains(F.lower(name)),
            F.transform(
                offsets(masked, whole_word(name), lambda i: F.length(name)),
                lambda at: _match(at, "exact", no, F.length(name), F.lit(1.0), F.substring(masked, at + 1, F.length(name))),
            ),
        ).otherwise(_no_matches()),
    )
    return F.flatten(per_name)


def _tokens() -> Column:
    """Words outside URLs without markdown marks, as (lower text, text, index)."""
    raw = F.regexp_extract_all(C("_masked"), F.lit(_TOKEN), F.lit(0))
    words = F.transform(
        raw, lambda r, i: F.struct(
            F.regexp_replace(F.regexp_replace(r, rf"^[{SPACED}{MASK}]+", ""), r"^[*_`#]+|[*_`#]+$", "").alias("text"), i.alias("i"))
    )
    return F.filter(words, lambda w: w["text"] != "")


def _token_offset(i: Column, text: Column) -> Column:
    """Offset of token ``i``: the length of everything before it, plus its leading separators and marks."""
    pieces = C("_pieces")
    before = F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, p: a + F.length(p))
    piece = F.element_at(pieces, i + 1)
    return before + F.instr(piece, text) - 1


def edit_cap(name: Column) -> Column:
    return F.when(F.length(name) <= 4, 1).when(F.length(name) <= 7, 2).otherwise(3)


def fuzzy_matches(df: DataFrame, floor: float = K.FUZZY_FLOOR) -> Column:
    """Near matches of names of three or more characters: single words, and word groups for names of several words.

    Length and capped edit distance are tested before the similarity, so it runs on few pairs. Names of up to
    four characters go by edit distance alone, longer ones need a similarity as well.
    """
    shape = "array<struct<text:string,at:int,len:int,distance:int>>"

    def candidates(name: Column) -> Column:
        cap, n = edit_cap(name), F.size(F.split(name, r"\s+"))
        count = F.size("_tokens") - n + 1
        near = lambda text: (F.lower(text) != name) & F.levenshtein(F.lower(text), name, 3).between(0, cap)
        joined = lambda g: F.array_join(F.transform(g, lambda t: t["text"]), " ")
        words = F.filter("_tokens", lambda t: (F.abs(F.length(t["text"]) - F.length(name)) <= 2) & near(t["text"]))
        grams = F.filter(
            F.transform(F.sequence(F.lit(1), count), lambda s: F.slice("_tokens", s, n)), lambda g: near(joined(g)))

        def from_word(t: Column) -> Column:
            return F.struct(
                t["text"].alias("text"), _token_offset(t["i"], t["text"]).alias("at"), F.length(t["text"]).alias("len"),
                F.levenshtein(F.lower(t["text"]), name).alias("distance"))

        def from_group(g: Column) -> Column:
            first, last = F.element_at(g, 1), F.element_at(g, -1)
            at = _token_offset(first["i"], first["text"])
            end = _token_offset(last["i"], last["text"]) + F.length(last["text"])
            return F.struct(
                joined(g).alias("text"), at.alias("at"), (end - at).alias("len"),
                F.levenshtein(F.lower(joined(g)), name).alias("distance"))

        several = (n > 1) & (count > 0) & (F.length(name) > 4)
        groups = F.when(several, F.transform(grams, from_group).cast(shape)).otherwise(F.array().cast(shape))
        return F.when(F.length(name) > 2, F.concat(F.transform(words, from_word).cast(shape), groups)).otherwise(
            F.array().cast(shape))

    def matches(name: Column, no: Column) -> Column:
        n = F.length(name)
        scored = F.transform(
            candidates(name),
            lambda c: F.struct(c.alias("c"), F.when(n > 4, jaro_winkler(F.lower(c["text"]), name)).alias("jw")))
        least = F.when(n <= 7, max(K.FUZZY_FLOOR_MEDIUM, floor)).otherwise(floor)
        return F.transform(
            F.filter(scored, lambda x: (n <= 4) | (x["jw"] >= least)),
            lambda x: _match(
                x["c"]["at"], "fuzzy", no, x["c"]["len"],
                F.when(n <= 4, 1 - x["c"]["distance"] / F.greatest(F.length(x["c"]["text"]), n)).otherwise(x["jw"]) * 0.9,
                x["c"]["text"]),
        )

    return F.flatten(F.transform(F.transform("names", F.lower), matches))


def contextual_matches(df: DataFrame) -> Column:
    """URLs whose host is an own domain of the brand, confidence 0.85."""
    links = F.regexp_extract_all("text", F.lit(URL), F.lit(0))
    at = offsets(C("text"), URL, lambda i: F.length(F.element_at(links, i)))
    found = F.zip_with(
        at, links, lambda a, u: F.when(F.array_contains("domains", urls.bare_host(u)),
                                       _match(a, "contextual", F.lit(0), F.length(u), F.lit(0.85), u)))
    return F.when(C("text").contains("://"), F.filter(found, lambda m: m.isNotNull())).otherwise(_no_matches())


STRATEGIES: dict[str, Callable[[DataFrame], Column]] = {
    "exact": exact_matches, "fuzzy": fuzzy_matches, "contextual": contextual_matches,
}


def dedupe_matches(matches: Column, radius: int = K.DEDUPE_RADIUS) -> Column:
    """Fold matches in text order, always against the last one kept: the better of two within the radius stays."""
    priority = F.create_map(*[x for k, v in K.MATCH_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    score = lambda m: m["confidence"] * 10 + F.element_at(priority, m["kind"])

    def step(kept: Column, m: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        better = F.when(score(m) > score(last), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(m))).otherwise(kept)
        near = (F.size(kept) > 0) & (m["at"] - last["at"] < radius)
        return F.when(near, better).otherwise(F.concat(kept, F.array(m)))

    return F.aggregate(F.sort_array(matches), _no_matches(), step)


def add_matches(
    answers: DataFrame, config: DataFrame, strategies: dict[str, Callable[[DataFrame], Column]] | None = None
) -> DataFrame:
    """Answers with brand settings and the raw ``matches`` of all strategies."""
    strategies = STRATEGIES if strategies is None else strategies
    df = answers.join(config, "project_id").withColumn("_masked", mask_urls(C("text")))
    df = df.withColumn("_pieces", F.regexp_extract_all("_masked", F.lit(_TOKEN), F.lit(0)))
    df = df.withColumn("_tokens", _tokens())
    found = reduce(F.concat, [s(df) for s in strategies.values()]) if strategies else _no_matches()
    return df.withColumn("matches", found).drop("_pieces", "_tokens")


def mention_type(context: Column) -> Column:
    c = F.lower(context)
    return (
        F.when(contains_any(c, K.RECOMMENDATION_PHRASES), "recommendation")
        .when(contains_any(c, K.COMPARISON_PHRASES), "comparison")
        .when(contains_any(c, K.CITATION_PHRASES), "citation")
        .otherwise("passing")
    )


def sentiment_score(text: Column) -> Column:
    t = F.lower(text)
    return count_present(t, K.POSITIVE_WORDS) - count_present(t, K.NEGATIVE_WORDS)


def sentiment(text: Column) -> Column:
    """Keyword sentiment: more positive than negative words present, or the other way round."""
    s = sentiment_score(text)
    return F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral")


def relative_position(offset: Column, length: Column) -> Column:
    share = F.coalesce(F.try_divide(offset, length), F.lit(0.0))
    return F.when(share < 0.33, "top").when(share < 0.66, "middle").otherwise("bottom")


def add_kept(df: DataFrame, min_confidence: float = K.MIN_CONFIDENCE, radius: int = K.DEDUPE_RADIUS,
             max_mentions: int | None = None) -> DataFrame:
    """Confidence filter and overlap dedupe, as array ``kept``; with ``max_mentions`` only the first of an answer."""
    sure = F.filter("matches", lambda m: m["confidence"] >= min_confidence)
    usable = trim_ws(C("text")) != ""
    kept = dedupe_matches(sure, radius)
    return df.withColumn("kept", F.when(usable, kept if max_mentions is None else F.slice(kept, 1, max_mentions)).otherwise(_no_matches()))


def mention_rows(kept: DataFrame, context_chars: int = K.CONTEXT_CHARS) -> DataFrame:
    """One row per mention with context, position, type and keyword sentiment. The text itself is not exploded."""
    items = F.transform(
        "kept",
        lambda m: F.struct(
            m.alias("m"), context_window(C("text"), m["at"], F.length(m["text"]), context_chars).alias("context"),
            relative_position(m["at"], F.length("text")).alias("relative"),
        ),
    )
    carried = [c for c in ("snapshot_id", "project_id", "brand", "ai_engine", "queried_at") if c in kept.columns]
    rows = explode_items(kept, carried, items, "i", "pos")
    return rows.select(
        *carried, (C("pos") + 1).alias("mention_no"), C("i.m.at").alias("position"), C("i.m.text").alias("matched_text"),
        C("i.m.kind").alias("match_type"), C("i.m.confidence").alias("confidence"), C("i.context").alias("context_text"),
        C("i.relative").alias("relative_position"),
    ).withColumns({"mention_type": mention_type(C("context_text")), "sentiment": sentiment(C("context_text"))})


def extract_mentions(answers: DataFrame, config: DataFrame, **options) -> DataFrame:
    """Answers -> mentions: strategies, confidence filter, dedupe, one row per mention."""
    return mention_rows(add_kept(add_matches(answers, config), **options))


def token_spans(text: Column | str) -> Column:
    """The tokens of a text as array<struct<token, at, is_url>>; markdown marks are stripped.

    Running lengths over the pieces of a text give the offsets in linear time, which array expressions cannot,
    so this one is an Arrow function over whole texts.
    """
    token, url, marks = re.compile(rf"[^{SPACED}]+"), re.compile(URL), re.compile(r"^[*_`#]+|[*_`#]+$")

    def spans(text: str) -> list:
        inside = [m.span() for m in url.finditer(text)]
        out, k = [], 0
        for m in token.finditer(text):
            word = marks.sub("", m.group())
            if not word:
                continue
            at = m.start() + m.group().index(word)
            while k < len(inside) and inside[k][1] <= at:
                k += 1
            out.append((word, at, k < len(inside) and inside[k][0] <= at))
        return out

    @F.pandas_udf("array<struct<token:string,at:int,is_url:boolean>>")
    def spans_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else spans(t))

    return spans_of(text)


def tokenize(answers: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """One row per token with its offset and a flag for tokens inside URLs."""
    rows = explode_items(answers, [key], token_spans("text"), "t", "token_no")
    return rows.select(key, "token_no", "t.token", C("t.at").alias("position"), "t.is_url")
