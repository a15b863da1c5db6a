"""Citations in answer texts: extraction, sources, Reddit links, answer cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import urls
from sightline.functions.arrays import explode_items
from sightline.functions.text import contains_any, trim_ws
from sightline.operators.mentions import offsets

C = F.col
_MARKDOWN = r"\[[^\]]+\]\(https?://[^\s)]+\)"
_ANGLE = r"<https?://[^\s<>]+>"
_FOOTNOTE = r"\[\d+\][:.\s]+\s*https?://[^\s<>)]+"
_INLINE = r"(?<![(<])\bhttps?://[^\s<>\"'\]\[)]+"
# Leftmost match first, so that a URL inside a longer form is not seen twice.
CITATION = f"{_MARKDOWN}|{_ANGLE}|{_FOOTNOTE}|{_INLINE}"
CONTEXT = 250


def with_citation_items(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``citation_items`` of a text. The matches are a column of their own first, as lambdas would search for them again."""
    found = df.withColumn("_found", F.regexp_extract_all(C(text), F.lit(CITATION), F.lit(0)))
    return found.withColumn(name, citation_items(C(text), C("_found"))).drop("_found")


def citation_items(text: Column, found: Column) -> Column:
    """Citations of a text in order: raw and canonical URL, host, offset, and the snippet around it. ``found``: the matches."""
    at = offsets(text, CITATION, lambda i: F.length(F.element_at(found, i)))

    def item(a: Column, m: Column) -> Column:
        link = F.regexp_extract(m, r"^\[[^\]]+\]\((https?://[^\s)]+)\)$", 1)
        loose = F.regexp_replace(F.regexp_extract(m, r"(https?://.*)$", 1), r"[.,;:!?)\]]+$", "")
        raw = F.when(link != "", link).when(m.startswith("<"), F.regexp_replace(m, "^<|>$", "")).otherwise(loose)
        length = F.when(m.startswith("http"), F.length(raw)).otherwise(F.length(m))
        start = F.greatest(F.lit(0), a - CONTEXT)
        snippet = trim_ws(F.substring(text, start + 1, a + length + CONTEXT - start))
        return F.struct(
            raw.alias("raw_url"), urls.canonical(raw).alias("url"), urls.host(raw).alias("domain"), a.alias("position"),
            snippet.alias("snippet"),
        )

    items = F.filter(F.zip_with(at, found, item), lambda i: i["url"].isNotNull())
    return F.when(text.contains("://"), items)


def extract_citations(answers: DataFrame, key: str = "snapshot_id", text: str = "text") -> DataFrame:
    """One row per citation of an answer, in document order. Repeated URLs stay."""
    carried = [c for c in answers.columns if c != text]
    items = with_citation_items(answers, text, "_items")
    return explode_items(items, carried, "_items", "c", "citation_no").select(*carried, "citation_no", "c.*")


def citation_urls(text: Column) -> Column:
    """Distinct URLs of a text: markdown links first, then all others without trailing punctuation."""
    links = F.regexp_extract_all(text, F.lit(r"\]\((https?://[^\s)]+)\)"), F.lit(1))
    inline = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?i)\bhttps?://[^\s<>()\"']+"), F.lit(0)),
        lambda u: F.regexp_replace(u, r"[.,;:!?)\]}'\"`]+$", ""),
    )
    return F.array_distinct(F.concat(links, inline))


SOURCES = "array<struct<raw_url:string,url:string,domain:string,position:int,snippet:string>>"


def add_sources(answers: DataFrame, provider: DataFrame | None = None, key: str = "snapshot_id") -> DataFrame:
    """Add ``sources`` and ``source_type``: citations in the text, then provider citations not seen there, or an unstructured marker.

    ``provider`` (key, url, title): of several with one canonical URL the least (url, title) counts, in the order of these URLs. Answers without any source but with
    wording such as "experts say" have one source of type ``unstructured``.
    """
    base = with_citation_items(answers, "text", "_inline").withColumn("_inline", F.coalesce(C("_inline").cast(SOURCES), F.array().cast(SOURCES)))
    sources = C("_inline")
    if provider is not None:
        # the canonical text of a provider URL keeps its query; only the fragment goes
        plain = F.regexp_replace(F.concat(urls.origin(C("url")), urls.path(C("url")), F.regexp_extract("url", r"(\?.*)$", 1)), "#.*$", "")
        once = provider.filter(urls.host(C("url")).isNotNull()).groupBy(key, plain.alias("plain")).agg(
            F.min(F.struct("url", F.coalesce("title", F.lit("")).alias("title"))).alias("p"))
        extra = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
            "plain", C("p.url").alias("raw_url"), urls.host(C("p.url")).alias("domain"), C("p.title").alias("title")))).alias("_provider"))
        base = base.join(extra, key, "left").withColumn("_seen", F.transform("_inline", lambda c: c["url"]))
        fresh = F.filter("_provider", lambda p: ~F.array_contains("_seen", p["plain"]))
        more = F.transform(fresh, lambda p: F.struct(
            p["raw_url"].alias("raw_url"), p["plain"].alias("url"), p["domain"].alias("domain"), F.length("text").alias("position"), p["title"].alias("snippet")))
        sources = F.concat(sources, F.coalesce(more.cast(SOURCES), F.array().cast(SOURCES)))
    base = base.withColumn("sources", sources)
    marker = F.array(F.struct(
        F.lit(None).cast("string").alias("raw_url"), F.lit("").alias("url"), F.lit("").alias("domain"),
        F.lit(None).cast("int").alias("position"), F.lit("").alias("snippet"))).cast(SOURCES)
    vague = (F.size("sources") == 0) & contains_any(F.lower("text"), K.UNSTRUCTURED_MARKERS)
    rows = base.withColumn("source_type", F.when(vague, "unstructured").otherwise("structured"))
    return rows.withColumn("sources", F.when(C("source_type") == "unstructured", marker).otherwise(C("sources"))).drop("_inline", "_provider", "_seen")


def source_rows(rows: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """One row per source of ``add_sources``. The own-domain flag is true for an own domain and its subdomains."""
    own = F.exists("domains", lambda d: (C("s.domain") == d) | C("s.domain").endswith(F.concat(F.lit("."), d)))
    return explode_items(rows, [key, "project_id", "source_type", "domains"], "sources", "s").select(
        key, "project_id", "source_type", "s.url", "s.domain", "s.position",
        ((C("s.domain") != "") & F.coalesce(own, F.lit(False))).alias("is_own_domain"))


def attribute_sources(
    answers: DataFrame, config: DataFrame, provider: DataFrame | None = None, key: str = "snapshot_id"
) -> DataFrame:
    """The sources of answers, one row each."""
    return source_rows(add_sources(answers.join(config.select("project_id", "domains"), "project_id", "left"), provider, key), key)


# --- Reddit ---------------------------------------------------------------------------------------

REDDIT = r"(?i)^(?:https?://)?(?:www\.|old\.|new\.|m\.)?reddit\.com/r/([^/]+)/comments/([^/]+)(?:/[^/]*(?:/([^/?#]+))?)?"


def reddit_parts(url: Column) -> Column:
    u = trim_ws(url)
    group = lambda n: F.nullif(F.regexp_extract(u, REDDIT, n), F.lit(""))
    return F.struct(F.lower(group(1)).alias("subreddit"), group(2).alias("post_id"), group(3).alias("comment_id"))


def link_reddit(answers: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Link answers (citation_id, raw_response) to the posts and comments they cite.

    A known comment gives 1.0, a known post 1.0, and a known post of an unknown comment 0.7; the first link of an
    answer to a post decides.
    """
    links = F.array_distinct(
        F.regexp_extract_all("raw_response", F.lit(r"(?i)\bhttps?://(?:www\.|old\.|new\.|m\.)?reddit\.com/[^\s)\]]+"), F.lit(0)))
    found = explode_items(answers, ["citation_id"], links, "u", "no").select(
        "citation_id", "no", reddit_parts(C("u")).alias("p")).select("citation_id", "no", "p.post_id", "p.comment_id").filter(
        C("post_id").isNotNull())
    known_c = comments.select(C("reddit_id").alias("comment_id"), F.lit(True).alias("_c")).distinct()
    known_p = posts.select(C("reddit_id").alias("post_id"), F.lit(True).alias("_p")).distinct()
    j = found.join(known_c, "comment_id", "left").join(known_p, "post_id", "left")
    rows = j.filter(C("_c") | C("_p")).select(
        "citation_id", "no", F.when(C("_c"), "comment").otherwise("post").alias("mention_type"),
        F.when(C("_c"), C("comment_id")).otherwise(C("post_id")).alias("mention_id"),
        F.when(C("_c") | C("comment_id").isNull(), 1.0).otherwise(0.7).alias("confidence"))
    return rows.groupBy("citation_id", "mention_type", "mention_id").agg(F.min_by("confidence", "no").alias("confidence"))


# --- cost -----------------------------------------------------------------------------------------


def answer_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost in cents with four decimals; an unknown model costs 0. Exact decimal arithmetic."""
    price = lambda side: F.try_element_at(
        F.create_map(*[x for row in K.MODEL_PRICES for x in (F.lit(row[0]), F.lit(row[side]).cast("decimal(10,2)"))]), model)
    tokens = lambda c: c.cast("decimal(18,0)")
    cents = (tokens(input_tokens) * price(1) + tokens(output_tokens) * price(2)) / F.lit(10_000).cast("decimal(5,0)")
    return F.coalesce(F.round(cents, 4), F.lit(0)).cast("decimal(18,4)")
