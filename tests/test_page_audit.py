"""Checks on hand-written pages and side files; expected points follow the rubric tables."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import scoring
from sightline.operators.rubrics import CheckRegistry
from sightline.operators.site_checks import SITE_RUBRICS, bot_access, site_files
from sightline.plans.page_audit import PAGE_CHECKS, audit_pages, audit_sites, full_audit, registry
from sightline.sources.html import page_facts

LONG = "This paragraph has well over fifty characters of visible text in it, truly."


def check(spark, html, check_id, url="https://www.site.example/a"):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, final_url string, html string")
    row = audit_pages(pages, "2024-02-01", PAGE_CHECKS.subset((check_id,))).collect()[0]
    return row["score"], row["status"], {i["criterion"]: i["got"] for i in row["issues"]}


def test_facts_of_broken_markup():
    f = page_facts(
        '<html lang="en"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body>'
        f"<p><b>One<br><p>{LONG}</p><!-- <p>no</p> --><ul><li>a<li>b</ul><noscript><p>x</p></noscript></body>")
    assert f["title"] == "A & B" and f["lang"] == "en"
    tags = dict(f["tag_counts"])
    assert tags["p"] == 2 and tags["ul"] == 1  # not the ones in the comment, the script and noscript
    assert [p["chars"] for p in f["paragraphs"]] == [3, len(LONG)]
    assert f["inline_script_chars"] == len('var t="</p>";') and f["noscript_chars"] == 8


def test_first_paragraph_outside_navigation():
    f = page_facts(f"<body><nav><p>{LONG}</p></nav><main><p>short</p><p>{LONG}</p></main></body>")
    assert f["first_p_index"] == 5 and f["first_p_in_content"]


def test_meta_tags_full_and_noindex(spark):
    head = (
        "<title>A fine page title</title><meta name='description' content='" + "d" * 60 + "'>"
        "<link rel='canonical' href='https://www.site.example/a'><meta property='og:title' content='t'>"
        "<meta property='og:description' content='d'>")
    assert check(spark, f"<html lang='de'><head>{head}</head></html>", "meta-tags")[:2] == (100, "pass")
    score, status, _ = check(spark, f"<html lang='de'><head>{head}<meta name='robots' content='NOINDEX'></head></html>", "meta-tags")
    assert (score, status) == (10, "fail")
    assert check(spark, "<html></html>", "meta-tags")[0] == 0


def test_duplicate_titles_cost_five(spark):
    _, _, issues = check(spark, "<title>A fine page title</title><title>Again</title>", "meta-tags")
    assert issues["no_duplicates"] == 5


@pytest.mark.parametrize(
    ("block", "score"),
    [
        ('{"@context":"https://schema.org","@type":"Organization","name":"n","url":"u"}', 10 + 15 + 10 + 25 + 25 + 5),
        ('{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"n","url":"u"},{"@type":["WebSite","WebPage"],"name":"n","url":"u"}]}', 100),
        ("{broken", 10),
        ('[{"@type":"Person","name":"p"}]', 10 + 15 + 10 + 15 + 15),
    ],
)
def test_schema_org(spark, block, score):
    assert check(spark, f'<script type="application/ld+json">{block}</script>', "schema-org")[0] == score


def test_content_freshness_reads_all_sources(spark):
    html = (
        '<script type="application/ld+json">{"@type":"Article","datePublished":"Jan 5, 2024","dateModified":"2024-01-20T10:00:00Z"}</script>'
        '<meta property="article:published_time" content="2024-01-05"><time datetime="2024-01-01">x</time>')
    assert check(spark, html, "content-freshness")[0] == 10 + 8 + 7 + 30 + 20 + 15 + 10


def test_citation_readiness_counts_other_hosts_only(spark):
    html = (
        '<main><a href="/x">i</a><a href="https://site.example/y">same</a><a href="//other.example/z">o</a>'
        '<a href="mailto:a@b.c">m</a> 1 and 2,000</main>')
    _, _, issues = check(spark, html, "citation-readiness")
    assert issues["external_links"] == 5 and issues["numbers"] == 3


def test_js_rendering_of_an_empty_app(spark):
    score, _, issues = check(spark, '<body><div id="root"></div><script src="/app.js"></script></body>', "js-rendering")
    assert score == 0 and issues["script_weight"] == 0


def test_unreadable_page_is_an_error(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", None), (2, "https://a.example/", "<p>x</p>")], "page_id long, final_url string, html string")
    checks = audit_pages(pages, "2024-02-01", PAGE_CHECKS.subset(("performance",)))
    got = {r["page_id"]: (r["status"], r["score"]) for r in checks.collect()}
    assert got[1] == ("error", 0) and got[2][0] != "error"
    assert {r["page_id"]: r["overall_score"] for r in scoring.scan_scores(checks, "page_id").collect()}[1] == 0


def files(spark, **contents):
    names = {"robots": "/robots.txt", "sitemap": "/sitemap.xml", "llms": "/llms.txt", "agents": "/agents.md", "mcp": "/.well-known/mcp.json"}
    return spark.createDataFrame([("s", names[k], v, 200) for k, v in contents.items()], "site string, path string, content string, status_code int")


def site_check(spark, check_id, **contents):
    return audit_sites(files(spark, **contents), registry({check_id: SITE_RUBRICS[check_id]})).collect()[0]["score"]


def test_robots_scores(spark):
    every = "User-agent: GPTBot\nAllow: /\nUser-agent: *\nAllow: /\nSitemap: https://s/x.xml"
    assert site_check(spark, "robots-txt", robots=every) == 100
    assert site_check(spark, "robots-txt", robots="User-agent: *\nDisallow: /") == 10 + 10
    assert site_check(spark, "robots-txt", llms="x") == 55  # no robots file
    assert site_check(spark, "robots-txt", robots=" \n") == 10


def test_specific_group_beats_the_general_one(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: ClaudeBot\nDisallow:\nAllow: /  # all\n"
    got = {r["bot"]: r["access"] for r in bot_access(site_files(files(spark, robots=text))).collect()}
    assert got["ClaudeBot"] == "allowed" and got["GPTBot"] == "blocked"


def test_sitemap_llms_agents_and_mcp(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "<url><loc>u</loc><lastmod>d</lastmod></url>" * 11 + "</urlset>"
    assert site_check(spark, "sitemap-xml", sitemap=xml) == 20 + 15 + 20 + 20 + 5
    llms = "# T\n> q\n## S\n- [a](b): c\n" + "w" * 200
    assert site_check(spark, "llms-txt", llms=llms) == 100
    agents = "# T\n## Supported bots\n- action one\nmail me@example.com\n" + "w" * 200
    assert site_check(spark, "agents-md", agents=agents) == 100
    mcp = '{"mcpServers":{"a":{"url":"https://x.example","transport":"sse","description":"d"}}}'
    assert site_check(spark, "webmcp", mcp=mcp) == 100
    assert site_check(spark, "webmcp", mcp='{"mcpServers":{"a":1}}') == 35
    assert site_check(spark, "webmcp", mcp="[") == 15


def test_html_instead_of_text_counts_as_missing(spark):
    assert site_check(spark, "llms-txt", llms="  <!DOCTYPE html><html></html>", robots="User-agent: *") == 0


def test_full_audit_has_every_check_once(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x", "<p>x</p>"), (2, "https://b.example/", "<p>y</p>")], "page_id long, final_url string, html string")
    side = files(spark, robots="User-agent: *").withColumn("site", F.lit("https://a.example"))
    got = full_audit(pages, side, "2024-02-01").groupBy("page_id").agg(F.count_distinct("check_id").alias("n"), F.count(F.lit(1)).alias("m"))
    assert {(r["n"], r["m"]) for r in got.collect()} == {(14, 14)}


def test_registry_refuses_doubles():
    reg = CheckRegistry()
    reg.register("x", "readability", "important", 1, lambda: None)
    with pytest.raises(ValueError, match="already registered"):
        reg.register("x", "readability", "important", 1, lambda: None)
    with pytest.raises(ValueError, match="category"):
        reg.register("y", "nonsense", "important", 1, lambda: None)
