"""Crawl graph jobs over fetched pages: links, permissions, breadth-first frontier, page status."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import urls
from sightline.functions.text import trim_ws
from sightline.operators.site_checks import add_robots_groups
from sightline.operators.skew import top_k_per_key
from sightline.session import checkpoint_dir, shared_table

C = F.col
HREF = r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'#]+?)(?:#[^"']*)?["']"""


def internal_links(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """Same-origin link edges (keys, url, link), fragments dropped, each once."""
    refs = F.array_distinct(F.transform(F.regexp_extract_all(C(html), F.lit(HREF), F.lit(1)), trim_ws))
    rows = pages.select(*keys, url, F.explode_outer(refs).alias("ref")).filter(C("ref").isNotNull())
    rejected = F.lower("ref").rlike("^(?:" + "|".join(re.escape(x) for x in K.REJECT_SCHEMES) + ")")
    links = rows.filter((C("ref") != "") & ~rejected).withColumn("link", urls.resolve(C("ref"), C(url)))
    # a reference without a host of its own stays on the page's; the test would resolve it again
    foreign = C("ref").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|[/\\\\]{2})")
    return links.filter(urls.origin(C(url)).isNotNull()).filter(~foreign | (urls.origin(C("link")) == urls.origin(C(url)))).select(*keys, url, "link").distinct()


def crawler_rules(robots: DataFrame, agent: str, key: str = "site", content: str = "content") -> DataFrame:
    """Disallow prefixes for a crawler (its groups and ``*``) and sitemap lines per site."""
    parsed = add_robots_groups(robots, content)
    mine = F.filter("robots_groups", lambda g: (g["agent"] == "*") | g["agent"].startswith(agent.lower()))
    return parsed.select(
        key, F.array_distinct(F.flatten(F.transform(mine, lambda g: g["disallow"]))).alias("disallow"),
        F.array_distinct(F.filter("robots_sitemaps", lambda s: s != "")).alias("sitemaps"))


def path_allowed(path: Column, disallow: Column) -> Column:
    """True unless a disallow prefix starts the path. Allow lines are not consulted."""
    return ~F.exists(F.coalesce(disallow, F.array().cast("array<string>")), lambda p: path.startswith(p))


def sitemap_urls(xml: Column) -> Column:
    """Struct of page URLs and nested sitemap URLs of a sitemap text."""
    every = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    nested = F.regexp_extract_all(xml, F.lit(r"(?i)<sitemap>\s*<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    # bound as members of arrays, so that the text is searched once and not per URL; a text of one kind needs no comparison
    found = F.array(F.struct(every.alias("every"), nested.alias("nested")))
    with_pages = F.transform(found, lambda f: F.struct(f["every"].alias("every"), f["nested"].alias("nested"), F.array_except(f["every"], f["nested"]).alias("pages")))
    parsed = F.transform(with_pages, lambda f: F.struct(
        F.when(F.size(f["nested"]) == 0, f["every"]).when(F.size(f["pages"]) == 0, f["pages"]).otherwise(
            F.filter(f["every"], lambda u: F.array_contains(f["pages"], u))).alias("urls"),
        f["nested"].alias("indexes")))
    return parsed[0]


#: sitemaps of an index that are followed
INDEX_ENTRIES = 3


def sitemap_seeds(files: DataFrame, starts: DataFrame) -> DataFrame:
    """(crawl_id, url): the pages that the sitemaps of each crawl list. Of an index the first three entries are followed, one level deep.

    ``files`` (crawl_id, url, content): fetched sitemaps, ``starts`` (crawl_id, url): where they begin. Parsing happens in the row of a file; the
    entries of an index find their files by an equi-join.
    """
    keys = ["crawl_id", "url"]
    parsed = files.select(*keys, sitemap_urls(C("content")).alias("s"))
    first = starts.select(*keys).distinct().join(parsed, keys)
    nested = first.select("crawl_id", F.explode(F.slice("s.indexes", 1, INDEX_ENTRIES)).alias("url")).distinct()
    listed = [x.select("crawl_id", F.explode("s.urls").alias("url")) for x in (first, nested.join(parsed, keys))]
    return listed[0].unionByName(listed[1]).distinct()


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows as a bucketed table in the shared folder: joins on ``keys`` read it without a shuffle of its own."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/{table}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def crawl_frontier(
    roots: DataFrame, edges: DataFrame, fetched: DataFrame, rules: DataFrame, seeds: DataFrame | None = None,
    max_depth: int = 3, max_pages: int | None = None,
) -> DataFrame:
    """Breadth-first result per crawl: url, depth and status completed, failed or blocked.

    ``roots`` (crawl_id, url), ``edges`` (crawl_id, url, link), ``fetched`` (crawl_id, url, http_status), ``rules``
    (crawl_id, disallow), ``seeds`` (crawl_id, url: sitemap pages, depth 1). Only completed pages are followed. If ``max_pages`` is set, only the
    first pages by (depth, url) of a crawl are kept.

    Semi-naive: edges and fetched pages are written once, bucketed by page, so a level shuffles its frontier only; each level is a
    table of its own that is appended to those seen, and lost executors do not restart the crawl.
    """
    keys = ["crawl_id", "url"]
    edges, fetched = bucketed(edges.select(*keys, "link"), keys, "edges"), bucketed(fetched.select(*keys, "http_status"), keys, "fetched")
    rules = shared_table(rules, "rules")

    def visit(level: DataFrame) -> DataFrame:
        j = level.join(fetched, keys, "left").join(rules, "crawl_id", "left")
        status = F.when(~path_allowed(urls.path(C("url")), C("disallow")), "blocked").when(
            C("http_status").between(200, 299), "completed").otherwise("failed")
        return j.select(*keys, "depth", status.alias("status"), F.when(status != "blocked", C("http_status")).alias("http_status"))

    def cap(pages: DataFrame) -> DataFrame:
        if max_pages is None:
            return pages
        return top_k_per_key(pages, ["crawl_id"], [C("depth"), C("url")], max_pages, "_rank").drop("_rank")

    frontier = seen = shared_table(visit(roots.select(*keys).distinct().withColumn("depth", F.lit(0))), "level")
    for depth in range(1, max_depth + 1):
        reached = frontier.filter(C("status") == "completed").select(*keys).join(edges, keys).select("crawl_id", C("link").alias("url"))
        if depth == 1 and seeds is not None:
            reached = reached.unionByName(seeds.select(*keys))
        fresh = reached.distinct().join(seen.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth))
        frontier = shared_table(visit(fresh), "level")
        if max_pages is None:
            seen = seen.unionByName(frontier)
        else:  # a page over the limit is not followed
            seen = shared_table(cap(seen.unionByName(frontier)), "seen")
            frontier = seen.filter(C("depth") == depth)
    return seen


def crawl_stats(pages: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """Pages found and scanned, mean score, and the ``k`` weakest pages of each crawl.

    ``pages`` (crawl_id, url, status), ``scores`` (crawl_id, url, score).
    """
    totals = pages.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(C("status") == "completed").alias("scanned"))
    means = scores.groupBy("crawl_id").agg(F.avg("score").alias("avg_score"))
    weak = top_k_per_key(scores.select("crawl_id", "url", "score"), ["crawl_id"], [C("score"), C("url")], k)
    lists = weak.groupBy("crawl_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("weakest"))
    return totals.join(means, "crawl_id", "left").join(lists, "crawl_id", "left")
