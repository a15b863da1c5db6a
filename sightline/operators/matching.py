"""Matching citation URLs to known pages, and keyword matching between two tables.

No step compares all pairs of a host. A page's path is cut into three segments; two edits leave one of them as it is, and
it stands in the other path at one of a few places that follow from both lengths. Equal segments meet in an
equi-join, and the edit distance decides. Popular hosts spread over the segments of their paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import urls
from sightline.operators.skew import latest_per_key

C = F.col
FUZZY_DISTANCE = 2


def _segments(n: Column) -> list[tuple[Column, Column]]:
    """(start, length) of the three segments of a string of ``n`` characters."""
    first = F.floor(n / 3)
    second = F.floor((n - first) / 2)
    return [(F.lit(0), first), (first, second), (first + second, n - first - second)]


def _segment_hash(x: Column, n: Column, number: int, start: Column, length: Column) -> Column:
    return F.xxhash64(n, F.lit(number), F.substring(x, (start + 1).cast("int"), length.cast("int")))


def page_segments(x: Column) -> Column:
    """Hashes of the three segments of a path, with its length."""
    n = F.char_length(x)
    return F.array(*[_segment_hash(x, n, i, *seg) for i, seg in enumerate(_segments(n))])


def possible_segments(x: Column) -> Column:
    """Hashes of the 19 places of a path where an unchanged segment of a path within two edits can be.

    If the other path is ``d`` characters shorter, a segment with i segments before it moved by at most i characters, and by at
    most the edits that are left from ``d``.
    """
    m, k = F.char_length(x), FUZZY_DISTANCE
    found = []
    for d in range(-k, k + 1):
        n = m - d
        for i, (start, length) in enumerate(_segments(n)):
            for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
                inside = (n >= 0) & (start + shift >= 0) & (start + shift + length <= m)
                found.append(F.when(inside, _segment_hash(x, n, i, start + shift, length)))
    return F.array_distinct(F.filter(F.array(*found), lambda h: h.isNotNull()))


def match_pages(citation_urls: DataFrame, candidates: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Best known page per URL: manual alias, exact URL, same host and path, near path, else unmatched.

    ``citation_urls`` (url), ``candidates`` (client_page_id, url, candidate_order), ``aliases`` (url,
    client_page_id). Confidence 100 for alias and exact, 80 for path, 70 less 10 per edit for near paths (at most
    two edits). Among equals the first candidate by order wins. Each distinct URL is matched once.
    """
    wanted = citation_urls.select("url").filter(C("url").isNotNull()).distinct().select(
        "url", urls.bare_host(C("url")).alias("host"), urls.match_path(C("url")).alias("path"))
    known = candidates.select(
        "client_page_id", C("url").alias("page_url"), "candidate_order",
        urls.bare_host(C("url")).alias("host"), urls.match_path(C("url")).alias("path"))

    pick = F.min_by("client_page_id", "candidate_order").alias("client_page_id")
    exact = known.groupBy(C("page_url").alias("url")).agg(pick.alias("exact_id"))
    same_path = known.filter(C("host").isNotNull()).groupBy("host", "path").agg(pick.alias("path_id"))
    found = wanted.join(exact, "url", "left").join(same_path, ["host", "path"], "left")
    if aliases is not None:
        manual = aliases.groupBy("url").agg(F.min("client_page_id").alias("manual_id"))
        found = found.join(manual, "url", "left")
    else:
        found = found.withColumn("manual_id", F.lit(None).cast("long"))

    # near paths only for what is still open
    open_paths = found.filter(
        C("manual_id").isNull() & C("exact_id").isNull() & C("path_id").isNull() & C("host").isNotNull()
    ).select("host", "path").distinct()
    hosts = open_paths.select("host").distinct()
    pages = known.join(hosts, "host", "left_semi").groupBy("host", C("path").alias("page_path")).agg(
        F.min_by("client_page_id", "candidate_order").alias("client_page_id"), F.min("candidate_order").alias("candidate_order"))
    left = open_paths.select("host", "path", F.explode(possible_segments(C("path"))).alias("_v"))
    right = pages.select("host", "page_path", "client_page_id", "candidate_order", F.explode(page_segments(C("page_path"))).alias("_v"))
    distance = F.levenshtein(C("path"), C("page_path"), FUZZY_DISTANCE)
    near = left.join(right, ["host", "_v"]).filter(
        (F.abs(F.length("path") - F.length("page_path")) <= FUZZY_DISTANCE) & (distance >= 0)
    ).groupBy("host", "path").agg(
        F.min(F.struct(distance.alias("distance"), "candidate_order", "client_page_id")).alias("_near"))
    found = found.join(near, ["host", "path"], "left")
    return found.select(
        "url",
        F.coalesce("manual_id", "exact_id", "path_id", "_near.client_page_id").alias("client_page_id"),
        F.when(C("manual_id").isNotNull(), "manual").when(C("exact_id").isNotNull(), "exact")
        .when(C("path_id").isNotNull(), "path").when(C("_near").isNotNull(), "fuzzy").otherwise("unmatched").alias("match_type"),
        F.when(C("manual_id").isNotNull() | C("exact_id").isNotNull(), 100).when(C("path_id").isNotNull(), 80)
        .when(C("_near").isNotNull(), 70 - 10 * C("_near.distance")).otherwise(0).alias("confidence"),
    )


#: distinct keywords in one automaton
KEYWORD_BLOCK = 200_000


def keyword_hits(texts: DataFrame, keywords: DataFrame, key: str, text: str = "text", keyword: str = "keyword", block: int = KEYWORD_BLOCK) -> DataFrame:
    """Rows (key, the columns of ``keywords``) where the lower-case text contains the keyword.

    The distinct keywords are dealt into blocks of at most ``block``, each an Aho-Corasick automaton that every task builds once; the texts
    stream past it in their own partitions, once for each block, and only (key, word) pairs leave. Null and empty keywords hit nothing.
    """
    spark = texts.sparkSession
    words = keywords.withColumn("_word", F.lower(keyword))
    distinct = words.filter(C("_word") != "").select("_word").distinct()
    own = texts.select(C(key).alias("_key"), F.lower(C(text)).alias("_text")).filter("_text IS NOT NULL")
    kind = own.schema["_key"].dataType.simpleString()
    blocks, held, hits = [], [], None
    for row in distinct.toLocalIterator():  # one block at a time on the driver
        held.append(row["_word"])
        if len(held) == block:
            blocks.append(spark.sparkContext.broadcast(held))
            held = []
    if held or not blocks:
        blocks.append(spark.sparkContext.broadcast(held))
    for sent in blocks:
        found = own.mapInArrow(_searcher(sent), f"_key {kind}, _word string")
        hits = found if hits is None else hits.unionByName(found)
    return hits.join(words, "_word").drop("_word").withColumnRenamed("_key", key)


def _searcher(sent):
    """A function over batches (_key, _text) that gives (_key, _word) for each of the sent words that a text contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in sent.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            at, words = [], []
            if sent.value:
                for i, own in enumerate(batch.column("_text").to_pylist()):
                    met = {word for _, word in automaton.iter(own)}
                    at += [i] * len(met)
                    words += met
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(at, pa.int64())), pa.array(words, pa.string())], ["_key", "_word"])

    return run


def keyword_mentions(posts: DataFrame, comments: DataFrame, keywords: DataFrame, sentiment) -> DataFrame:
    """Brand links for posts and comments whose text contains a brand keyword.

    ``keywords`` (brand_id, keyword, enabled); ``sentiment`` is a Column function, so that another classifier, such
    as a pandas UDF, can take its place. A post or comment is linked to a brand once, by its first keyword.
    Comments need a known post.
    """
    active = keywords.filter(C("enabled") & (F.btrim("keyword") != "")).select("brand_id", "keyword")
    post_text = F.concat_ws("\n\n", "title", F.coalesce("body", F.lit("")))
    items = posts.select(F.lit("post").alias("mention_type"), C("reddit_id").alias("mention_id"), post_text.alias("text")).unionByName(
        comments.join(posts.select(C("reddit_id").alias("post_id")).distinct(), "post_id", "left_semi").select(
            F.lit("comment").alias("mention_type"), C("reddit_id").alias("mention_id"), C("body").alias("text")))
    items = items.withColumn("item", F.concat_ws(":", "mention_type", "mention_id"))
    hits = keyword_hits(items, active, "item").groupBy("item", "brand_id").agg(F.min("keyword").alias("keyword"))
    # sentiment only of the items that were hit
    labels = items.join(hits.select("item").distinct(), "item", "left_semi").select("item", "mention_type", "mention_id", sentiment(C("text")).alias("sentiment"))
    return hits.join(labels, "item").drop("item")


def latest_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], prefix: str) -> DataFrame:
    """Parents with the columns of their latest child (null without one). Replaces a lookup per parent."""
    last = latest_per_key(children, [key], order)
    renamed = last.select(key, *[C(c).alias(f"{prefix}{c}") for c in last.columns if c != key])
    return parents.join(renamed, key, "left")


def by_either_key(entities: DataFrame, wanted: DataFrame, keys: tuple[str, str], entity_id: str) -> DataFrame:
    """Entities whose first or second key is wanted (``wanted``: key), each once."""
    long = entities.select(entity_id, F.explode(F.array_distinct(F.array(*[C(k) for k in keys]))).alias("key"))
    hits = long.join(wanted.select("key").distinct(), "key", "left_semi").select(entity_id).distinct()
    return entities.join(hits, entity_id, "left_semi")
