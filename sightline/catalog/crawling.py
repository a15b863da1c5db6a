"""Crawl graph results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.catalog.audit import _PAGE_FACTS, SLICE_SCORES, slice_scores
from sightline.catalog.views import encoded_sql, sql
from sightline.operators import crawl as W

C = F.col


def crawl_pages(t):
    """Ten sites made of the test pages; page i of a site links to three others, outside and to a mail address."""
    k = C("page_id")
    site, i = k % 10, F.floor(k / 10)
    base = F.concat(F.lit("https://c"), site, F.lit(".example"))
    link = lambda n: F.concat(F.lit('<a class="x" href="/p'), n, F.lit('">l</a>'))
    html = F.concat(link(i * 2 + 1), F.lit("<a href='p"), i * 2 + 2, F.lit("#top'>"), link(i * 3 + 5),
                    F.lit('<a href="mailto:a@b.c">m</a><a href="https://other.example/p1">o</a>'), C("html"))
    status = F.when(k % 17 == 13, 404).otherwise(200)
    return t.raw("pages").select(
        site.alias("crawl_id"), F.concat(base, F.lit("/p"), i).alias("url"), html.alias("html"), status.alias("http_status"), "page_id")


_PAGES = "cp AS (SELECT page_id % 10 AS crawl_id, page_id // 10 AS i, 'https://c' || page_id % 10 || '.example/p' || page_id // 10 AS url, CASE WHEN page_id % 17 = 13 THEN 404 ELSE 200 END AS http_status, html, page_id FROM pages)"
_EDGES = f"""ce AS (SELECT DISTINCT crawl_id, url, link FROM (
  SELECT crawl_id, url, 'https://c' || crawl_id || '.example/p' || unnest([i * 2 + 1, i * 2 + 2, i * 3 + 5]) AS link FROM cp
  UNION ALL SELECT crawl_id, url, 'https://c' || crawl_id || '.example' || {encoded_sql("ref")} FROM (SELECT crawl_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"#]+)"', 1)) AS ref FROM cp)))"""


@query("link_edges", f"WITH {_PAGES}, {_EDGES} SELECT crawl_id, url, link FROM ce")
def link_edges(t):
    return W.internal_links(crawl_pages(t), ["crawl_id"])


def _robots(t):
    k = C("page_id") % 10
    text = F.concat(F.lit("User-agent: *\nDisallow: /p1"), k, F.lit("\n\nUser-agent: Spider\nDisallow: /p2\nAllow: /\nUser-agent: other\nDisallow: /\nSitemap: https://c"), k, F.lit(".example/sitemap.xml"))
    return t.raw("pages").select(k.alias("site"), text.alias("content")).distinct()


@query("crawler_rules", "SELECT DISTINCT page_id % 10 AS site, '/p1' || page_id % 10 || ' /p2' AS disallow, 'https://c' || page_id % 10 || '.example/sitemap.xml' AS sitemaps FROM pages")
def crawler_rules(t):
    return W.crawler_rules(_robots(t), "spider").select("site", F.array_join("disallow", " ").alias("disallow"), F.array_join("sitemaps", " ").alias("sitemaps"))


@query("allowed_pages", f"WITH {_PAGES} SELECT url FROM cp WHERE NOT (i::VARCHAR LIKE '1' || crawl_id || '%' OR i::VARCHAR LIKE '2%')")
def allowed_pages(t):
    from sightline.functions import urls

    rules = W.crawler_rules(_robots(t), "spider").select(C("site").alias("crawl_id"), "disallow")
    return crawl_pages(t).join(rules, "crawl_id").filter(W.path_allowed(urls.path(C("url")), C("disallow"))).select("url")


@query("sitemap_urls", sql("SELECT site, len(regexp_extract_all(sitemap, '<loc>')) AS urls, 0 AS indexes FROM side_files WHERE sitemap IS NOT NULL", "side_files"))
def sitemap_urls(t):
    maps = t.side_files().filter((C("path") == "/sitemap.xml") & (C("status_code") == 200))
    s = maps.select("site", W.sitemap_urls(C("content")).alias("s"))
    return s.select("site", F.size("s.urls").alias("urls"), F.size("s.indexes").alias("indexes"))


def _sitemaps(t):
    """Per site an index of four sitemaps; sitemap n lists every eleventh page from page 9 + n on."""
    site = C("page_id") % 10
    base = F.concat(F.lit("https://c"), site, F.lit(".example"))
    loc = lambda *x: F.concat(F.lit("<loc> "), *x, F.lit(" </loc>"))
    pages = t.raw("pages").select(site.alias("crawl_id"), base.alias("base"), F.floor(C("page_id") / 10).alias("i"))
    entries = pages.filter((C("i") >= 9) & ((C("i") - 9) % 11 < 4)).withColumn("n", (C("i") - 9) % 11)
    nested = entries.groupBy("crawl_id", "base", "n").agg(F.array_join(F.collect_list(F.concat(F.lit("<url>"), loc("base", F.lit("/p"), "i"), F.lit("</url>"))), "").alias("x"))
    nested = nested.select("crawl_id", F.concat("base", F.lit("/sitemap-"), "n", F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("content"))
    index = pages.select("crawl_id", "base").distinct().select(
        "crawl_id", F.concat("base", F.lit("/sitemap.xml")).alias("url"),
        F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap>"), loc("base", F.lit(f"/sitemap-{n}.xml")), F.lit("</sitemap>")) for n in range(4)], F.lit("</sitemapindex>")).alias("content"))
    return index.unionByName(nested)


_SEEDS = "seeds AS (SELECT crawl_id, url FROM cp WHERE i >= 9 AND (i - 9) % 11 < 3)"


@query("sitemap_seeds", f"WITH {_PAGES}, {_SEEDS} SELECT crawl_id, url FROM seeds")
def sitemap_seeds(t):
    """Pages listed by the first three sitemaps of each site's index."""
    files = _sitemaps(t)
    return W.sitemap_seeds(files, files.filter(C("url").endswith("/sitemap.xml")))


def _crawl(t):
    pages = crawl_pages(t)
    roots = pages.select("crawl_id", F.concat(F.lit("https://c"), "crawl_id", F.lit(".example/p0")).alias("url")).distinct()
    seeds = W.sitemap_seeds(_sitemaps(t), roots.select("crawl_id", F.replace("url", F.lit("/p0"), F.lit("/sitemap.xml")).alias("url")))
    rules = W.crawler_rules(_robots(t), "spider").select(C("site").alias("crawl_id"), "disallow")
    return W.crawl_frontier(roots, W.internal_links(pages, ["crawl_id"]), pages.select("crawl_id", "url", "http_status"), rules, seeds)


_BFS = f"""WITH RECURSIVE {_PAGES}, {_EDGES}, {_SEEDS},
st AS (SELECT crawl_id, link AS url FROM ce UNION SELECT crawl_id, url FROM ce UNION SELECT crawl_id, url FROM seeds),
stat AS (SELECT st.crawl_id, st.url, http_status, CASE WHEN split_part(st.url, '/', 4) LIKE 'p1' || st.crawl_id || '%' OR split_part(st.url, '/', 4) LIKE 'p2%' THEN 'blocked' WHEN http_status = 200 THEN 'completed' ELSE 'failed' END AS status
  FROM st LEFT JOIN cp USING (crawl_id, url)),
bfs AS (SELECT DISTINCT crawl_id, 'https://c' || crawl_id || '.example/p0' AS url, 0 AS depth FROM cp
  UNION SELECT crawl_id, url, 1 FROM seeds
  UNION SELECT b.crawl_id, link, depth + 1 FROM bfs b JOIN stat s ON s.crawl_id = b.crawl_id AND s.url = b.url AND status = 'completed' JOIN ce ON ce.crawl_id = b.crawl_id AND ce.url = b.url WHERE depth < 3),
f AS (SELECT crawl_id, url, min(depth) AS depth FROM bfs GROUP BY 1, 2)
"""


@query("crawl_frontier", _BFS + "SELECT crawl_id, url, depth, status FROM f JOIN stat USING (crawl_id, url)")
def crawl_frontier(t):
    """Breadth-first crawl of the ten sites, with robots rules, sitemap seeds and failed pages."""
    return _crawl(t).select("crawl_id", "url", "depth", "status")


@query("crawl_statistics", _BFS + """, r AS (SELECT crawl_id, url, count(*) AS one, count_if(status = 'completed') AS done FROM f JOIN stat USING (crawl_id, url) GROUP BY 1, 2),
""" + f"{_PAGE_FACTS.strip()}, {SLICE_SCORES}" + """,
sc AS (SELECT cp.crawl_id, cp.url, score, row_number() OVER (PARTITION BY cp.crawl_id ORDER BY score, cp.url) AS rn FROM cp JOIN r USING (crawl_id, url) JOIN slice_scores USING (page_id)),
g AS (SELECT crawl_id, avg(score) AS avg_score, string_agg(url, ' ' ORDER BY rn) FILTER (rn <= 5) AS weakest FROM sc GROUP BY 1)
SELECT crawl_id, sum(one)::BIGINT AS found, sum(done)::BIGINT AS scanned, any_value(avg_score) AS avg_score, any_value(weakest) AS weakest FROM r LEFT JOIN g USING (crawl_id) GROUP BY 1""")
def crawl_statistics(t):
    """Crawl totals with the mean and the weakest pages by their audit scores."""
    crawled = _crawl(t)
    pages = crawl_pages(t)
    scores = slice_scores(t, C("page_id")).select("page_id", C("overall_score").alias("score"))
    of_page = pages.select("page_id", "crawl_id", "url").join(scores, "page_id").join(crawled.select("crawl_id", "url"), ["crawl_id", "url"], "left_semi")
    stats = W.crawl_stats(crawled, of_page)
    return stats.select("crawl_id", "found", "scanned", "avg_score", F.array_join("weakest", " ").alias("weakest"))
