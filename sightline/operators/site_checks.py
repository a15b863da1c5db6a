"""Checks over the side files of a site (robots, sitemap, llms.txt, agents file, MCP file).

All of it is native: a file is one row, and lines, groups and links are array expressions over its text, so no
shuffle is needed beyond the pivot that brings the files of a site together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import json_text as J
from sightline.functions import urls
from sightline.functions.numbers import points, steps
from sightline.functions.text import WS_CHARS, lines, trim_ws
from sightline.operators.rubrics import CRITICAL, MINOR, Criterion, Gate, Rubric

C = F.col
DIRECTIVE = r"(?i)^(user-agent|disallow|allow|crawl-delay|sitemap)[ \t]*:"
HTML_TAG = r"(?i)<[a-z][a-z0-9]*[\s>]"


def is_html(content: Column) -> Column:
    """A soft 404: an HTML document where a text file was expected."""
    return F.ltrim(content, F.lit(WS_CHARS)).rlike(r"^(<!DOCTYPE|<html|<HTML)")


def usable_side_files(files: DataFrame) -> DataFrame:
    """Side files of the known paths that were delivered (2xx) and are no HTML page."""
    return files.filter(
        C("path").isin(*K.SIDE_PATHS) & C("status_code").between(200, 299) & ~is_html(C("content"))
    )


def site_files(files: DataFrame) -> DataFrame:
    """One row per site with a column per file; the first of two paths wins where there are two."""
    by_path = usable_side_files(files).groupBy("site").pivot("path", list(K.SIDE_PATHS)).agg(F.max("content"))
    file = lambda p: C(f"`{p}`")
    return by_path.select(
        "site",
        file("/robots.txt").alias("robots"),
        file("/sitemap.xml").alias("sitemap"),
        F.coalesce(file("/llms.txt"), file("/llms-full.txt")).alias("llms"),
        F.coalesce(file("/.well-known/agents.md"), file("/agents.md")).alias("agents"),
        file("/.well-known/mcp.json").alias("mcp"),
    )


# --- robots ---------------------------------------------------------------------------------------


def robots_lines(content: Column) -> Column:
    """Lines without comments and blanks."""
    stripped = F.transform(lines(content), lambda l: trim_ws(F.split_part(l, F.lit(" #"), F.lit(1))))
    return F.filter(stripped, lambda l: (l != "") & ~l.startswith("#"))


def _value(line: Column) -> Column:
    return trim_ws(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))


def add_robots_groups(df: DataFrame, content: str = "robots") -> DataFrame:
    """Parse robots text into ``robots_groups`` (agent and its rules), sitemap lines and malformed lines.

    Every user-agent line opens a group of its own. Splitting the cleaned text at those lines keeps the parse
    linear in the length of the file.
    """
    df = df.withColumn("robots_lines", robots_lines(C(content)))
    pieces = F.split(F.array_join("robots_lines", "\n"), r"(?im)^user-agent[ \t]*:[ \t]*")
    df = df.withColumn("_pieces", pieces)
    group = F.transform(
        F.slice("_pieces", 2, F.greatest(F.size("_pieces") - 1, F.lit(0))),
        lambda g: F.struct(
            F.lower(trim_ws(F.split_part(g, F.lit("\n"), F.lit(1)))).alias("agent"),
            F.filter(F.split(g, "\n"), lambda l: l.rlike(r"(?i)^disallow[ \t]*:")).alias("disallow"),
            F.filter(F.split(g, "\n"), lambda l: l.rlike(r"(?i)^allow[ \t]*:")).alias("allow"),
        ),
    )
    group = F.transform(
        group,
        lambda g: F.struct(
            g["agent"].alias("agent"),
            F.filter(F.transform(g["disallow"], _value), lambda v: v != "").alias("disallow"),
            F.transform(g["allow"], _value).alias("allow"),
        ),
    )
    orphans = F.size(
        F.filter(F.split(F.element_at("_pieces", 1), "\n"), lambda l: l.rlike(r"(?i)^(disallow|allow|crawl-delay)[ \t]*:"))
    )
    return df.withColumns(
        {
            "robots_groups": group,
            "robots_malformed": F.size(F.filter("robots_lines", lambda l: ~l.rlike(DIRECTIVE))) + orphans,
            "robots_sitemaps": F.transform(F.filter("robots_lines", lambda l: l.rlike(r"(?i)^sitemap[ \t]*:")), _value),
        }
    ).drop("_pieces")


def _group(agent: str) -> Column:
    """First group of an agent, null if there is none."""
    return F.try_element_at(F.filter("robots_groups", lambda g: g["agent"] == agent.lower()), F.lit(1))


def _blocks(group: Column) -> Column:
    return F.array_contains(group["disallow"], "/") & ~F.array_contains(group["allow"], "/")


def bot_status(bot: str) -> Column:
    """allowed, blocked or unspecified; the bot's own group first, else the ``*`` group."""
    group = F.coalesce(_group(bot), _group("*"))
    return F.when(group.isNull(), "unspecified").when(_blocks(group), "blocked").otherwise("allowed")


def bot_access(df: DataFrame, key: str = "site") -> DataFrame:
    """Long table of the status of every known bot per site."""
    bots = K.PRIMARY_BOTS + K.SECONDARY_BOTS
    entries = F.array(*[F.struct(F.lit(b).alias("bot"), bot_status(b).alias("access")) for b in bots])
    return add_robots_groups(df).select(key, F.explode(entries).alias("e")).select(key, "e.bot", "e.access")


def robots_txt() -> Rubric:
    total, bad = F.size("robots_lines"), C("robots_malformed")
    primary = F.array(*[F.lit(b.lower()) for b in K.PRIMARY_BOTS])
    named = F.exists("robots_groups", lambda g: F.array_contains(primary, g["agent"]))
    open_to = lambda bots: sum(((bot_status(b) != "blocked").cast("int") for b in bots), F.lit(0))
    everyone = F.coalesce(_blocks(_group("*")), F.lit(False))
    return Rubric(
        [
            Criterion("present", F.lit(10), 10),
            Criterion("valid_syntax", points((total == 0) | (bad / total < 0.3), 10), 10),
            Criterion("ai_directives", points(named, 15), 15),
            Criterion("primary_bots", open_to(K.PRIMARY_BOTS) * 5, 30, CRITICAL),
            Criterion("secondary_bots", open_to(K.SECONDARY_BOTS) * 5, 10, CRITICAL),
            Criterion("sitemap_line", points(F.size("robots_sitemaps") > 0, 10), 10, MINOR),
            Criterion("no_blanket_block", points(~everyone, 15), 15, CRITICAL),
        ],
        gates=[
            Gate("missing", C("robots").isNull(), 55),
            Gate("html_body", is_html(C("robots")), 0),
            Gate("empty", trim_ws(C("robots")) == "", 10),
        ],
    )


# --- sitemap --------------------------------------------------------------------------------------


def sitemap_xml() -> Rubric:
    x = C("sitemap")
    count = lambda tag: F.regexp_count(x, F.lit(rf"(?i)<{tag}[\s>]"))
    urlset, index = x.rlike(r"(?i)<urlset[\s>]"), x.rlike(r"(?i)<sitemapindex[\s>]")
    entries = F.when(index & ~urlset, count("sitemap")).otherwise(count("url"))
    closed = (urlset & x.rlike(r"(?i)</urlset\s*>")) | (index & x.rlike(r"(?i)</sitemapindex\s*>"))
    share = lambda tag, full, some: points(
        (entries > 0) & (count(tag) >= entries * 0.5), full, points(count(tag) > 0, some)
    )
    namespace = F.regexp_extract(x, r'(?i)xmlns\s*=\s*"([^"]+)"', 1)
    return Rubric(
        [
            Criterion("present", F.lit(20), 20),
            Criterion("well_formed", points(closed, 15), 15),
            Criterion("entries", points(entries > 10, 20, points(entries > 0, 10)), 20),
            Criterion("lastmod", share("lastmod", 20, 10), 20),
            Criterion("changefreq", share("changefreq", 5, 2), 5, MINOR),
            Criterion("priority", share("priority", 5, 2), 5, MINOR),
            Criterion("robots_reference", points(F.coalesce(F.size("robots_sitemaps"), F.lit(0)) > 0, 10), 10, MINOR),
            Criterion("namespace", points(namespace == K.SITEMAP_NAMESPACE, 5), 5, MINOR),
        ],
        gates=[
            Gate("missing", x.isNull(), 0),
            Gate("html_body", is_html(x), 0),
            Gate("empty", trim_ws(x) == "", 20),
        ],
    )


# --- llms.txt and agents file ---------------------------------------------------------------------


def _heading_count(text: Column, marks: str) -> Column:
    return F.size(F.filter(lines(text), lambda l: l.rlike(rf"^{marks} .+")))


def llms_facts(x: Column) -> dict[str, Column]:
    """Structure of an llms.txt text; shared by the check and the artefact validation."""
    return {
        "h1": _heading_count(x, "#"),
        "quote": F.exists(lines(x), lambda l: l.rlike(r"^> .+")),
        "h2": _heading_count(x, "##"),
        "links": F.regexp_count(x, F.lit(r"- \[.+?\]\(.+?\)")),
        "described": F.regexp_count(x, F.lit(r"- \[.+?\]\(.+?\): .+")),
        "chars": F.length(x),
        "html": x.rlike(HTML_TAG),
    }


def llms_txt() -> Rubric:
    x = C("llms")
    f = llms_facts(x)
    return Rubric(
        [
            Criterion("present", F.lit(15), 15),
            Criterion("title", points(f["h1"] == 1, 25, points(f["h1"] > 1, 12)), 25, CRITICAL),
            Criterion("quote", points(f["quote"], 10), 10),
            Criterion("sections", points((f["h2"] > 0) & (f["links"] > 0), 20, points(f["h2"] > 0, 10)), 20),
            Criterion("descriptions", points(f["links"] > 0, points(f["described"] >= f["links"] / 2, 15, 7)), 15),
            Criterion("length", points(f["chars"] >= 200, 10), 10, MINOR),
            Criterion("no_html", points(~f["html"], 5), 5, MINOR),
        ],
        gates=[
            Gate("missing", x.isNull(), 0),
            Gate("html_body", is_html(x), 0),
            Gate("empty", trim_ws(x) == "", 15),
        ],
    )


def agents_facts(x: Column) -> dict[str, Column]:
    sections = F.filter(lines(x), lambda l: l.rlike(r"^#{2,3} .+"))
    return {
        "h1": _heading_count(x, "#"),
        "h2": _heading_count(x, "##"),
        "sections": F.size(sections),
        "agent_sections": F.size(F.filter(sections, lambda s: s.rlike(r"(?i)agent|bot|assistant|service"))),
        "capabilities": F.exists(lines(x), lambda l: l.rlike(r"^[-*]\s+"))
        & x.rlike(r"(?i)capabilit|skill|action|permission|scope|endpoint"),
        "contact": x.rlike(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
        | x.rlike(r"(?i)contact|kontakt|policy|richtlinie"),
        "chars": F.length(trim_ws(x)),
        "html": x.rlike(HTML_TAG),
    }


def agents_md() -> Rubric:
    x = C("agents")
    f = agents_facts(x)
    return Rubric(
        [
            Criterion("present", F.lit(15), 15),
            Criterion("title", points(f["h1"] == 1, 20, points(f["h1"] > 1, 10)), 20),
            Criterion("agent_sections", points(f["agent_sections"] > 0, 25, points(f["sections"] > 0, 12)), 25),
            Criterion("capabilities", points(f["capabilities"], 15), 15),
            Criterion("contact", points(f["contact"], 10), 10, MINOR),
            Criterion("length", points(f["chars"] >= 200, 10), 10, MINOR),
            Criterion("no_html", points(~f["html"], 5), 5, MINOR),
        ],
        gates=[
            Gate("missing", x.isNull(), 0),
            Gate("html_body", is_html(x), 0),
            Gate("empty", trim_ws(x) == "", 15),
        ],
    )


# --- MCP file -------------------------------------------------------------------------------------


def add_mcp_servers(df: DataFrame, content: str = "mcp") -> DataFrame:
    """Server entries of an MCP file: which of url, transport and description are usable."""
    text = F.regexp_replace(C(content), "^\ufeff", "")
    df = df.withColumn("mcp_valid", F.try_parse_json(text).isNotNull()).withColumn(
        "_servers", J.as_object(F.try_element_at(J.as_object(text), F.lit("mcpServers")))
    )
    entries = F.filter(
        F.transform(F.map_values("_servers"), J.as_object), lambda o: o.isNotNull()
    )
    get = lambda o, k: F.try_element_at(o, F.lit(k))
    servers = F.transform(
        entries,
        lambda o: F.struct(
            F.coalesce(urls.host(get(o, "url")).isNotNull(), F.lit(False)).alias("url"),
            F.coalesce(get(o, "transport").isin(*K.MCP_TRANSPORTS), F.lit(False)).alias("transport"),
            F.coalesce(trim_ws(get(o, "description")) != "", F.lit(False)).alias("description"),
        ),
    )
    return df.withColumn("mcp_servers", servers).drop("_servers")


def webmcp() -> Rubric:
    x, n = C("mcp"), F.size("mcp_servers")
    part = lambda name, most: F.floor(F.size(F.filter("mcp_servers", lambda s: s[name])) * most / n)
    return Rubric(
        [
            Criterion("valid_servers", F.lit(55), 55),
            Criterion("urls", part("url", 20), 20),
            Criterion("transports", part("transport", 15), 15, MINOR),
            Criterion("descriptions", part("description", 10), 10, MINOR),
        ],
        gates=[
            Gate("missing", x.isNull(), 0),
            Gate("html_body", is_html(x), 0),
            Gate("too_large", F.length(x) > K.MCP_MAX_CHARS, 15),
            Gate("empty", trim_ws(x) == "", 15),
            Gate("bad_json", ~C("mcp_valid"), 15),
            Gate("no_server", C("mcp_servers").isNull() | (n == 0), 35),
        ],
    )


def add_site_measures(files: DataFrame) -> DataFrame:
    return add_mcp_servers(add_robots_groups(files))


SITE_RUBRICS = {
    "robots-txt": robots_txt,
    "sitemap-xml": sitemap_xml,
    "llms-txt": llms_txt,
    "agents-md": agents_md,
    "webmcp": webmcp,
}
