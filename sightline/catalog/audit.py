"""Page and site audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import constants as K
from sightline.catalog import ORACLE, query
from sightline.catalog.views import host, sql
from sightline.functions import urls
from sightline.operators import scoring
from sightline.operators.artefacts import site_info
from sightline.operators.page_checks import rendering_class
from sightline.operators.site_checks import bot_access, site_files, usable_side_files
from sightline.plans.page_audit import (
    PAGE_CHECKS, SITE_CHECKS, audit_pages, audit_rows, audit_scores, audit_sites, audit_summary, full_audit, page_features,
)

C = F.col
AS_OF = "2024-02-01"

# text of a page part: tags out, the entities that occur in the test pages decoded
_TEXT = (
    "replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)


def _text(x: str) -> str:
    return _TEXT.replace("{0}", x)


_NO_CODE = "regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g')"
_TAGS = "len(regexp_extract_all({0}, '<[a-zA-Z][^>]*>'))"
_PAGE_FACTS = f"""
raw AS (SELECT page_id, url, html, {_NO_CODE} AS clean FROM pages),
facts AS (
  SELECT page_id, url, html, strlen(html) AS bytes, length(html) AS chars,
    {_TAGS.replace("{0}", "replace(html, 'var t=\"</p>\"', '')")} AS nodes,
    trim({_text("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title,
    trim({_text("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS h1,
    len(regexp_extract_all(html, '<p>')) AS p_count, string_split(clean, '<p>') AS segs, string_split(html, '<p>') AS rawsegs,
    strlen(trim({_text("clean")})) AS visible_bytes,
    length({_text("clean")}) + length(html) - length(clean) - len(regexp_extract_all(html, '</?(script|style)>')) * 8 AS text_chars,
    len(list_filter(string_split(regexp_replace({_text("regexp_extract(clean, '(?s)<body>(.*)', 1)")}, '\\s+', ' ', 'g'), ' '), lambda x: length(x) >= 2)) AS words
  FROM raw),
paras AS (
  SELECT page_id, i, length(trim({_text("regexp_replace(segs[i], '(?s)(</p>|<footer>).*', '')")})) AS chars,
    {_TAGS.replace("{0}", "replace(array_to_string(rawsegs[1:i-1], '<p>'), 'var t=\"</p>\"', '')")} AS before
  FROM (SELECT *, unnest(range(2, len(segs) + 1)) AS i FROM facts)),
first_p AS (SELECT page_id, arg_min(before, i) AS before FROM paras WHERE chars >= 50 GROUP BY 1),
visible_p AS (SELECT page_id, count(*) AS n FROM paras WHERE chars > 20 GROUP BY 1),
perf AS (SELECT page_id, 25 - CASE WHEN bytes < 102400 THEN 0 WHEN bytes < 512000 THEN 7 WHEN bytes < 1048576 THEN 15 ELSE 25 END
    + 15 + CASE WHEN nodes < 1000 THEN 20 WHEN nodes < 3000 THEN 15 WHEN nodes < 5000 THEN 10 ELSE 0 END
    + CASE WHEN visible_bytes / bytes > 0.3 THEN 25 WHEN visible_bytes / bytes > 0.15 THEN 18 WHEN visible_bytes / bytes > 0.08 THEN 10 ELSE 0 END + 15 AS score
  FROM facts),
meta AS (SELECT page_id, CASE WHEN length(title) BETWEEN 10 AND 60 THEN 25 WHEN length(title) > 0 THEN 17 ELSE 0 END
    + CASE WHEN regexp_matches(html, '<html lang="[^"]+"') THEN 10 ELSE 0 END + CASE WHEN length(title) > 0 THEN 10 ELSE 0 END AS score FROM facts),
structure AS (
  SELECT page_id, 8 + 10 + 3 + 6 + 3 + 3 + CASE WHEN p_count >= 5 THEN 8 WHEN p_count >= 3 THEN 5 WHEN p_count >= 1 THEN 2 ELSE 0 END
    + CASE WHEN text_chars / chars >= 0.25 THEN 7 WHEN text_chars / chars >= 0.15 THEN 5 WHEN text_chars / chars >= 0.08 THEN 3 ELSE 0 END + 3
    + CASE WHEN before IS NULL THEN 0 WHEN before / nodes <= 0.15 THEN 20 WHEN before / nodes <= 0.3 THEN 16 WHEN before / nodes <= 0.5 THEN 12 ELSE 8 END
    + CASE WHEN length(h1) >= 15 THEN 8 WHEN length(h1) >= 8 THEN 5 ELSE 2 END + 7 AS score
  FROM facts LEFT JOIN first_p USING (page_id)),
js AS (
  SELECT page_id, CASE WHEN words >= 100 THEN 30 WHEN words >= 50 THEN 22 WHEN words >= 20 THEN 15 WHEN words >= 5 THEN 8 ELSE 0 END
    + 5 + 2 + 5 + CASE WHEN coalesce(n, 0) >= 3 THEN 6 WHEN coalesce(n, 0) >= 1 THEN 3 ELSE 0 END + CASE WHEN words >= 50 THEN 10 ELSE 0 END
    + CASE WHEN words >= 5 THEN 15 ELSE 0 END + CASE WHEN words >= 50 THEN 7 ELSE 0 END + CASE WHEN length(title) > 0 THEN 3 ELSE 0 END AS score
  FROM facts LEFT JOIN visible_p USING (page_id))
"""


def _page_sql(body: str) -> str:
    return f"WITH {_PAGE_FACTS.strip()}\n{body}"


SLICE = ("performance", "meta-tags", "content-structure")


SLICE_SCORES = """
slice_scores AS (SELECT page_id, url, floor((3 * p.score + 11 * m.score + 10 * s.score) / 24.0 + 0.5)::BIGINT AS score
  FROM pages JOIN perf p USING (page_id) JOIN meta m USING (page_id) JOIN structure s USING (page_id))"""


def slice_scores(t, key):
    """Overall scores of the test pages by three checks, beside a column of the page id or the final URL."""
    checks = PAGE_CHECKS.subset(SLICE).results(page_features(t.pages(), AS_OF), "page_id", "final_url")
    scored = checks.select(key, "checks")
    return scoring.row_scores(scored, scored.columns[:1])


@query("host_audit", f"""WITH {_PAGE_FACTS.strip()}, {SLICE_SCORES}
SELECT {host('url')} AS host, count(*) AS pages, round(avg(score), 4) AS avg_score FROM slice_scores GROUP BY 1""")
def host_audit(t):
    """Flagship: pages -> facts -> three checks -> overall score -> average per host."""
    return slice_scores(t, urls.host(C("final_url")).alias("host")).groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg("overall_score"), 4).alias("avg_score"))


def _check(t, check_id, pages=None):
    return audit_pages(pages or t.pages(), AS_OF, PAGE_CHECKS.subset((check_id,))).select("page_id", "score", "status")


_STATUS = "CASE WHEN score < 40 THEN 'fail' WHEN score < 80 THEN 'warn' ELSE 'pass' END AS status"

for _id, _cte in (("performance", "perf"), ("content-structure", "structure"), ("js-rendering", "js")):
    def _make(check_id):
        return lambda t: _check(t, check_id)
    query(f"check_{_id.replace('-', '_')}", _page_sql(f"SELECT page_id, score::INT AS score, {_STATUS} FROM {_cte}"))(_make(_id))


@query("check_meta_tags", sql(f"""
SELECT page_id, least(CASE WHEN page_id % 5 = 0 THEN 10 ELSE 100 END,
  CASE WHEN length(title) BETWEEN 10 AND 60 THEN 25 WHEN title <> '' THEN 17 ELSE 0 END
  + CASE WHEN length(d) BETWEEN 50 AND 160 THEN 25 WHEN d <> '' THEN 17 ELSE 0 END
  + CASE WHEN regexp_matches(html, '<link rel="canonical" href="[^"]') THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches(html, '<html lang="[^"]+"') THEN 10 ELSE 0 END
  + CASE WHEN html LIKE '%property="og:title"%' THEN 8 ELSE 0 END + CASE WHEN title <> '' OR d <> '' THEN 10 ELSE 0 END)::INT AS score,
  {_STATUS.replace(' AS status', '')} AS status
FROM (SELECT page_id, html, trim({_text("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title,
  regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS d FROM rich_pages)""", "rich_pages"))
def check_meta_tags(t):
    return _check(t, "meta-tags", t.rich_pages())


@query("check_schema_org", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 0
  WHEN 1 THEN 10 + 15 + 10 + 25 + 25 + 0 + 5
  WHEN 2 THEN 10 + 15 + 10 + 25 + 15 + 10 + 0
  WHEN 3 THEN 10
  WHEN 4 THEN 10 + 15 + 10 + 25 + 25 + 5 + 5
  ELSE 10 + 15 + 10 + 15 + 12 + 0 + 0 END AS score,
  CASE page_id % 6 WHEN 0 THEN 'fail' WHEN 3 THEN 'fail' WHEN 5 THEN 'warn' ELSE 'pass' END AS status FROM pages""")
def check_schema_org(t):
    return _check(t, "schema-org", t.rich_pages())


@query("check_faq_schema", """
SELECT page_id, CASE WHEN page_id % 6 = 4 THEN 20 + 20 + 12 + 10 + 5 + 5 ELSE 0 END AS score,
  CASE WHEN page_id % 6 = 4 THEN 'warn' ELSE 'fail' END AS status FROM pages""")
def check_faq_schema(t):
    return _check(t, "faq-schema", t.rich_pages())


def _words_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: length(w) >= 2 AND regexp_matches(w, '[a-zäöüß]'))"


_STOP = ", ".join(f"'{w}'" for w in sorted(set(K.STOPWORDS)))
_SEMANTIC = f"""
WITH {_PAGE_FACTS.strip()},
txt AS (SELECT page_id, trim(regexp_replace({_text("regexp_extract(clean, '(?s)<article>(.*?)(</article>|$)', 1)")}, '\\s+', ' ', 'g')) AS content, {_text("clean")} AS whole FROM raw),
w AS (SELECT page_id, content, len({_words_sql('whole')}) AS all_words, {_words_sql('content')} AS cw,
    list_filter(list_transform(list_filter(list_transform(string_split_regex(content, '[.!?]+'), lambda t: trim(t)), lambda t: length(t) > 10), lambda t: len({_words_sql('t')})), lambda n: n > 0) AS sw,
    len(list_filter(list_transform(string_split_regex(content, '[.!?]+'), lambda t: trim(t)), lambda t: length(t) > 10)) AS sentences FROM txt),
pw AS (SELECT page_id, len({_words_sql("trim(" + _text("regexp_replace(segs[i], '(?s)(</p>|<footer>).*', '')") + ")")}) AS n, length(trim({_text("regexp_replace(segs[i], '(?s)(</p>|<footer>).*', '')")})) AS chars
  FROM (SELECT *, unnest(range(2, len(segs) + 1)) AS i FROM facts)),
ps AS (SELECT page_id, count(*) AS paragraphs, avg(n) AS mean_p, stddev_pop(n) AS dev_p FROM pw WHERE chars >= 10 AND n > 0 GROUP BY 1),
pl AS (SELECT page_id, unnest(list_filter(cw, lambda x: x NOT IN ({_STOP}))) AS word FROM w),
fr AS (SELECT page_id, count(*) AS uniq, sum(c) AS tot, max(c) AS top FROM (SELECT page_id, word, count(*) AS c FROM pl GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT w.*, coalesce(paragraphs, 0) AS paragraphs, coalesce(mean_p, 0) AS mean_p, CASE WHEN paragraphs > 1 THEN dev_p ELSE 0 END AS dev_p, coalesce(uniq / tot, 0) AS ttr, coalesce(top / tot, 0) AS top_share,
  coalesce(list_avg(sw), 0) AS mean_s, CASE WHEN len(sw) > 1 THEN list_stddev_pop(sw) ELSE 0 END AS dev_s, len(regexp_extract_all(content, '\\?')) AS q, len(regexp_extract_all(content, '\\b\\d[\\d.,]*\\b')) AS numbers,
  len(list_filter(cw, lambda x: length(x) >= 10)) AS longs FROM w LEFT JOIN ps USING (page_id) LEFT JOIN fr USING (page_id)),
s AS (SELECT page_id, (CASE WHEN all_words >= 300 THEN 10 WHEN all_words >= 150 THEN 7 WHEN all_words >= 50 THEN 4 ELSE 0 END + CASE WHEN sentences >= 10 THEN 5 WHEN sentences >= 5 THEN 3 ELSE 0 END
  + CASE WHEN paragraphs >= 5 THEN 7 WHEN paragraphs >= 3 THEN 5 WHEN paragraphs >= 1 THEN 2 ELSE 0 END
  + CASE WHEN mean_p BETWEEN 40 AND 120 THEN 7 WHEN mean_p BETWEEN 20 AND 200 THEN 5 WHEN paragraphs > 0 THEN 2 ELSE 0 END
  + CASE WHEN dev_p > 15 THEN 6 WHEN dev_p > 5 THEN 4 WHEN paragraphs > 1 THEN 2 ELSE 0 END
  + CASE WHEN ttr >= 0.6 THEN 10 WHEN ttr >= 0.4 THEN 7 WHEN ttr >= 0.2 THEN 4 WHEN all_words > 0 THEN 2 ELSE 0 END
  + CASE WHEN top_share < 0.03 THEN 5 WHEN top_share < 0.06 THEN 3 WHEN all_words > 0 THEN 1 ELSE 0 END
  + CASE WHEN mean_s BETWEEN 10 AND 25 THEN 8 WHEN mean_s BETWEEN 8 AND 35 THEN 5 WHEN sentences > 0 THEN 2 ELSE 0 END
  + CASE WHEN dev_s > 5 THEN 7 WHEN dev_s > 3 THEN 5 WHEN sentences > 1 THEN 2 ELSE 0 END + CASE WHEN q >= 2 THEN 5 WHEN q >= 1 THEN 3 ELSE 0 END
  + CASE WHEN len(cw) / all_words >= 0.6 THEN 15 WHEN len(cw) / all_words >= 0.4 THEN 10 WHEN len(cw) / all_words >= 0.2 THEN 5 ELSE 2 END
  + CASE WHEN numbers >= 5 THEN 5 WHEN numbers >= 2 THEN 3 ELSE 0 END + CASE WHEN longs >= 10 THEN 5 WHEN longs >= 5 THEN 3 WHEN longs >= 1 THEN 1 ELSE 0 END
  + least(5, (numbers + longs) // 3))::INT AS score FROM m)
SELECT page_id, score, {_STATUS} FROM s"""


@query("check_semantic_quality", _SEMANTIC)
def check_semantic_quality(t):
    return _check(t, "semantic-quality")


@query("check_citation_readiness", f"""
SELECT *, {_STATUS} FROM (SELECT page_id, (CASE WHEN page_id % 6 = 1 THEN 8 + 10 + 5 + 4 ELSE 0 END
  + CASE WHEN page_id % 4 = 1 THEN 4 + 0 ELSE 0 END + CASE WHEN page_id % 7 = 0 AND page_id % 6 <> 1 THEN 10 ELSE 0 END
  + CASE WHEN page_id % 3 = 1 THEN 5 + 4 + 3 + 6 ELSE 0 END
  + CASE WHEN page_id % 2 = 0 THEN 5 ELSE 0 END
  + CASE WHEN numbers >= 5 THEN 5 WHEN numbers >= 2 THEN 3 ELSE 0 END
  + CASE WHEN page_id % 4 = 0 THEN 4 + CASE WHEN page_id % 7 = 0 THEN 2 ELSE 0 END ELSE 0 END)::INT AS score
FROM (SELECT page_id, len(regexp_extract_all({_text("regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)")}, '\\b\\d[\\d.,]*\\b')) AS numbers FROM pages))""")
def check_citation_readiness(t):
    return _check(t, "citation-readiness", t.rich_pages())


@query("check_content_freshness", f"""SELECT *, {_STATUS} FROM (
WITH d AS (SELECT page_id,
    CASE WHEN page_id % 6 = 1 THEN make_timestamp(2023, page_id % 9 + 1, 15, 0, 0, 0) END AS ld,
    CASE WHEN page_id % 7 = 0 THEN make_timestamp(2022, 3, page_id % 28 + 1, 10, 0, 0) END AS meta,
    CASE WHEN page_id % 3 = 1 THEN TIMESTAMP '2023-11-05' END AS seen FROM pages),
a AS (SELECT *, date_diff('second', greatest(ld, meta, seen), TIMESTAMP '2024-02-01') / 86400.0 AS age,
    (ld IS NOT NULL)::INT + (meta IS NOT NULL)::INT + (seen IS NOT NULL)::INT AS channels FROM d)
SELECT page_id, ((ld IS NOT NULL)::INT * 10 + (meta IS NOT NULL)::INT * 8 + (seen IS NOT NULL)::INT * 7
  + CASE WHEN age <= 90 THEN 30 WHEN age <= 365 THEN 22 WHEN age <= 730 THEN 14 WHEN age <= 1095 THEN 6 ELSE 0 END
  + CASE channels WHEN 3 THEN 15 WHEN 2 THEN 10 WHEN 1 THEN 5 ELSE 0 END
  + CASE WHEN seen IS NOT NULL THEN 10 WHEN channels > 0 THEN 3 ELSE 0 END)::INT AS score FROM a)""")
def check_content_freshness(t):
    return _check(t, "content-freshness", t.rich_pages())


# --- the whole audit ------------------------------------------------------------------------------

# facts of the extended pages: their JSON blocks hold no tags, and a heading closes an open paragraph
_BASE = """regexp_replace(html, '(application/ld.json">).*?</script>', '\\1</script>', 'g') AS base"""
_RICH_FACTS = _PAGE_FACTS
for _plain, _rich in (
    ("SELECT page_id, url, html, regexp", f"SELECT page_id, final_url AS url, html, {_BASE}, regexp"), ("AS clean FROM pages", "AS clean FROM rich_pages"),
    ("replace(html, 'var t", "replace(base, 'var t"), ("regexp_extract_all(html, '<p>')", "regexp_extract_all(base, '<p>')"),
    ("string_split(html, '<p>')", "string_split(base, '<p>')"), ("* 8 AS text_chars", "* 8 - CASE WHEN page_id % 6 = 0 THEN 0 ELSE 36 END AS text_chars"),
    ("(</p>|<footer>)", "(</p>|<h3>|<footer>)"), ("8 + 10 + 3 + 6 + 3 + 3 +", "8 + 7 + 7 + 6 + 3 + 3 +"),
    ("length(h1) >= 15 THEN 8 WHEN length(h1) >= 8", "(length(h1) + length('Question ?' || page_id)) / 2 >= 15 THEN 8 WHEN (length(h1) + length('Question ?' || page_id)) / 2 >= 8"),
    ("+ 5 + 2 + 5 + CASE", "+ 5 + 4 + 5 + CASE WHEN page_id % 3 = 0 AND page_id % 200 > 0 THEN 3 ELSE 0 END + CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END + CASE"),
):
    if _plain not in _RICH_FACTS:
        raise ValueError(_plain)
    _RICH_FACTS = _RICH_FACTS.replace(_plain, _rich)


def _audit_sql(body: str) -> str:
    """Results ``c`` (page_id, check_id, score, category, weight) of all checks of the extended pages and their sites."""
    on_rich = {i: f"WITH {_RICH_FACTS.strip()} SELECT page_id, score FROM {cte}" for i, cte in (("performance", "perf"), ("content-structure", "structure"), ("js-rendering", "js"))}
    on_rich["semantic-quality"] = _SEMANTIC.replace(_PAGE_FACTS.strip(), _RICH_FACTS.strip()).replace("(</p>|<footer>)", "(</p>|<h3>|<footer>)")
    parts = []
    for check_id in K.CHECK_IDS:
        own = sql(on_rich[check_id], "rich_pages") if check_id in on_rich else ORACLE["check_" + check_id.replace("-", "_")]
        key = "substring(site, 6)::BIGINT" if check_id in SITE_CHECKS.ids() else "page_id"
        parts.append(f"SELECT {key} AS page_id, '{check_id}' AS check_id, score::BIGINT AS score FROM ({own})")
    checks = " UNION ALL ".join(parts)
    return sql(f"WITH c AS (SELECT page_id, x.check_id, score, category, weight FROM ({checks}) x JOIN check_dim USING (check_id))\n{body}", "check_dim")


def _mean_sql(condition: str) -> str:
    use = f"FILTER ({condition})"
    return f"floor(sum(score * weight) {use} / nullif(sum(weight) {use}, 0) + 0.5)::BIGINT"


def _gate_sql(level: int) -> str:
    ids = ", ".join(f"'{i}'" for i in K.LEVEL_GATES[level])
    return f"coalesce(min(score) FILTER (check_id IN ({ids})) >= {K.GATE_PASS}, true)"


_FUTURE = "check_id IN (" + ", ".join(f"'{i}'" for i in K.FUTURE_CHECKS) + ")"


@query("rendering_classes", _page_sql("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'static' WHEN 1 THEN CASE WHEN words >= 50 THEN 'ssr' ELSE 'partial-hydration' END
  WHEN 2 THEN 'partial-hydration' WHEN 3 THEN 'csr-spa' ELSE 'unknown' END AS rendering FROM facts"""))
def rendering_classes(t):
    """Pages as they are, with a framework's scripts, as a framework's shell, as an empty root, and with a script from elsewhere."""
    kind, shell = C("page_id") % 5, '<html><body><div id="{}">wait</div><script src="{}"></script></body></html>'
    with_script = lambda src: F.replace(C("html"), F.lit("</head>"), F.lit(f'<script src="{src}"></script></head>'))
    html = (
        F.when(kind == 1, with_script("/_next/static/a.js")).when(kind == 2, shell.format("page", "/_nuxt/a.js"))
        .when(kind == 3, shell.format("app", "/a.js")).when(kind == 4, with_script("/a.js")).otherwise(C("html")))
    return page_features(t.pages().withColumn("html", html), AS_OF).select("page_id", rendering_class().alias("rendering"))


# --- side files -----------------------------------------------------------------------------------

_ROBOTS = r"""
lined AS (SELECT site, robots, list_filter(list_transform(string_split(replace(replace(robots, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(split_part(x, ' #', 1))),
    lambda x: x <> '' AND NOT starts_with(x, '#')) AS ls FROM side_files),
pieces AS (SELECT *, string_split_regex(array_to_string(ls, chr(10)), '(?im)^user-agent[ \t]*:[ \t]*') AS ps FROM lined),
grouped AS (SELECT *, list_transform(ps[2:], lambda g: {'agent': lower(trim(split_part(g, chr(10), 1))),
    'blocked': regexp_matches(g, '(?im)^disallow[ \t]*:[ \t]*/[ \t]*$') AND NOT regexp_matches(g, '(?im)^allow[ \t]*:[ \t]*/[ \t]*$')}) AS gs FROM pieces),
access AS (SELECT site, bot, primary_bot, coalesce(list_filter(gs, lambda g: g.agent = lower(bot))[1], list_filter(gs, lambda g: g.agent = '*')[1]) AS grp
  FROM grouped, (VALUES ('GPTBot', true), ('ChatGPT-User', true), ('ClaudeBot', true), ('Claude-Web', true), ('PerplexityBot', true),
    ('Google-Extended', true), ('Googlebot', false), ('Bingbot', false)) b(bot, primary_bot)),
statuses AS (SELECT site, bot, CASE WHEN grp IS NULL THEN 'unspecified' WHEN grp.blocked THEN 'blocked' ELSE 'allowed' END AS access FROM access),
open_bots AS (SELECT site, count_if(access <> 'blocked') * 5 AS pts FROM statuses GROUP BY 1)
"""


@query("bot_access", sql(f"WITH {_ROBOTS} SELECT site, bot, access FROM statuses", "side_files"))
def bot_access_query(t):
    return bot_access(site_files(t.side_files()).select("site", F.coalesce("robots", F.lit("")).alias("robots")))


@query("usable_side_files", sql("""
SELECT path, count(*) AS files FROM (
  SELECT unnest([CASE WHEN robots IS NOT NULL THEN '/robots.txt' END, CASE WHEN sitemap IS NOT NULL THEN '/sitemap.xml' END,
    CASE WHEN k % 7 <> 0 THEN '/llms.txt' END, '/llms-full.txt', CASE WHEN agents IS NOT NULL THEN '/agents.md' END, '/.well-known/mcp.json']) AS path
  FROM side_files) WHERE path IS NOT NULL GROUP BY 1""", "side_files"))
def usable_files(t):
    return usable_side_files(t.side_files()).groupBy("path").agg(F.count(F.lit(1)).alias("files"))


def _site_check(t, check_id):
    return audit_sites(t.side_files(), SITE_CHECKS.subset((check_id,))).select("site", "score", "status")


@query("check_robots_txt", sql(f"""
WITH {_ROBOTS},
scored AS (SELECT site, CASE WHEN robots IS NULL THEN 55 WHEN trim(robots) = '' THEN 10 ELSE
  10 + CASE WHEN len(ls) = 0 OR (len(list_filter(ls, lambda l: NOT regexp_matches(l, '(?i)^(user-agent|disallow|allow|crawl-delay|sitemap)[ \\t]*:')))
        + len(list_filter(string_split(ps[1], chr(10)), lambda l: regexp_matches(l, '(?i)^(disallow|allow|crawl-delay)[ \\t]*:')))) / len(ls) < 0.3 THEN 10 ELSE 0 END
  + CASE WHEN len(list_filter(gs, lambda g: g.agent IN ('gptbot','chatgpt-user','claudebot','claude-web','perplexitybot','google-extended'))) > 0 THEN 15 ELSE 0 END
  + pts + CASE WHEN len(list_filter(ls, lambda l: regexp_matches(l, '(?i)^sitemap[ \\t]*:'))) > 0 THEN 10 ELSE 0 END
  + CASE WHEN coalesce(list_filter(gs, lambda g: g.agent = '*')[1].blocked, false) THEN 0 ELSE 15 END END::INT AS score
  FROM grouped JOIN open_bots USING (site))
SELECT site, score, {_STATUS} FROM scored""", "side_files"))
def check_robots_txt(t):
    return _site_check(t, "robots-txt")


@query("check_sitemap_xml", sql(f"""
WITH n AS (SELECT *, len(regexp_extract_all(sitemap, '<url[\\s>]')) AS u, len(regexp_extract_all(sitemap, '<lastmod[\\s>]')) AS m FROM side_files),
scored AS (SELECT site, CASE WHEN sitemap IS NULL THEN 0 ELSE 20 + CASE WHEN sitemap LIKE '%</urlset>%' THEN 15 ELSE 0 END
  + CASE WHEN u > 10 THEN 20 WHEN u > 0 THEN 10 ELSE 0 END + CASE WHEN u > 0 AND m >= u * 0.5 THEN 20 WHEN m > 0 THEN 10 ELSE 0 END
  + CASE WHEN coalesce(regexp_matches(robots, '(?m)^Sitemap:'), false) THEN 10 ELSE 0 END + 5 END::INT AS score FROM n)
SELECT site, score, {_STATUS} FROM scored""", "side_files"))
def check_sitemap_xml(t):
    return _site_check(t, "sitemap-xml")


@query("check_llms_txt", sql(f"""
WITH n AS (SELECT *, len(regexp_extract_all(llms, '(?m)^# .+')) AS h1, len(regexp_extract_all(llms, '(?m)^## .+')) AS h2,
  len(regexp_extract_all(llms, '- \\[.+?\\]\\(.+?\\)')) AS links, len(regexp_extract_all(llms, '- \\[.+?\\]\\(.+?\\): .+')) AS described FROM side_files),
scored AS (SELECT site, (15 + CASE WHEN h1 = 1 THEN 25 WHEN h1 > 1 THEN 12 ELSE 0 END + CASE WHEN regexp_matches(llms, '(?m)^> .+') THEN 10 ELSE 0 END
  + CASE WHEN h2 > 0 AND links > 0 THEN 20 WHEN h2 > 0 THEN 10 ELSE 0 END
  + CASE WHEN links > 0 THEN CASE WHEN described >= links / 2 THEN 15 ELSE 7 END ELSE 0 END
  + CASE WHEN length(llms) >= 200 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(llms, '(?i)<[a-z][a-z0-9]*[\\s>]') THEN 0 ELSE 5 END)::INT AS score FROM n)
SELECT site, score, {_STATUS} FROM scored""", "side_files"))
def check_llms_txt(t):
    return _site_check(t, "llms-txt")


@query("check_agents_md", sql(f"""
WITH n AS (SELECT *, len(regexp_extract_all(agents, '(?m)^# .+')) AS h1, regexp_extract_all(agents, '(?m)^#{{2,3}} .+') AS hs FROM side_files),
scored AS (SELECT site, CASE WHEN agents IS NULL THEN 0 ELSE 15 + CASE WHEN h1 = 1 THEN 20 WHEN h1 > 1 THEN 10 ELSE 0 END
  + CASE WHEN len(list_filter(hs, lambda h: regexp_matches(h, '(?i)agent|bot|assistant|service'))) > 0 THEN 25 WHEN len(hs) > 0 THEN 12 ELSE 0 END
  + CASE WHEN regexp_matches(agents, '(?m)^[-*]\\s+') AND regexp_matches(agents, '(?i)capabilit|skill|action|permission|scope|endpoint') THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches(agents, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') OR regexp_matches(agents, '(?i)contact|kontakt|policy|richtlinie') THEN 10 ELSE 0 END
  + CASE WHEN length(trim(agents)) >= 200 THEN 10 ELSE 0 END + 5 END::INT AS score FROM n)
SELECT site, score, {_STATUS} FROM scored""", "side_files"))
def check_agents_md(t):
    return _site_check(t, "agents-md")


@query("check_webmcp", sql(f"""
WITH scored AS (SELECT site, CASE WHEN NOT json_valid(mcp) THEN 15
  WHEN json_type(mcp, '$.mcpServers') <> 'OBJECT' OR len(json_keys(mcp, '$.mcpServers')) = 0 THEN 35 ELSE
  (55 + list_sum(list_transform(json_keys(mcp, '$.mcpServers'), lambda k: CASE WHEN json_extract_string(mcp, '$.mcpServers.' || k || '.url') LIKE 'http%://%' THEN 1 ELSE 0 END)) * 20 // len(json_keys(mcp, '$.mcpServers'))
    + list_sum(list_transform(json_keys(mcp, '$.mcpServers'), lambda k: CASE WHEN json_extract_string(mcp, '$.mcpServers.' || k || '.transport') IN ('sse','http','streamable-http') THEN 1 ELSE 0 END)) * 15 // len(json_keys(mcp, '$.mcpServers'))
    + list_sum(list_transform(json_keys(mcp, '$.mcpServers'), lambda k: CASE WHEN trim(coalesce(json_extract_string(mcp, '$.mcpServers.' || k || '.description'), '')) <> '' THEN 1 ELSE 0 END)) * 10 // len(json_keys(mcp, '$.mcpServers'))) END::INT AS score
  FROM side_files)
SELECT site, score, {_STATUS} FROM scored""", "side_files"))
def check_webmcp(t):
    return _site_check(t, "webmcp")


@query("full_audit_scores", _audit_sql(f"""
SELECT page_id, coalesce(overall, 0) AS overall_score, {", ".join(K.CATEGORIES)}, coalesce(now, 0) AS current_readiness, coalesce(later, 0) AS future_readiness,
  least(CASE WHEN coalesce(overall, 0) <= 20 THEN 0 WHEN overall <= 50 THEN 1 WHEN overall <= 75 THEN 2 ELSE 3 END, passed) AS readiness_level
FROM (SELECT page_id, {_mean_sql("true")} AS overall, {", ".join(_mean_sql(f"category = '{c}'") + f" AS {c}" for c in K.CATEGORIES)},
  {_mean_sql("NOT " + _FUTURE)} AS now, {_mean_sql(_FUTURE)} AS later,
  CASE WHEN NOT {_gate_sql(1)} THEN 0 WHEN NOT {_gate_sql(2)} THEN 1 WHEN NOT {_gate_sql(3)} THEN 2 ELSE 3 END AS passed FROM c GROUP BY 1)"""))
def full_audit_scores(t):
    """All 14 checks of every page, with the side files of its site, down to the scan scores."""
    pages = t.rich_pages()
    return audit_scores(audit_rows(pages, t.side_files(), AS_OF, site_of=F.concat(F.lit("site-"), C("page_id"))))


@query("full_audit_checks", _audit_sql(f"SELECT page_id, check_id, score, {_STATUS} FROM c"))
def full_audit_checks(t):
    """The same audit check by check."""
    found = full_audit(t.rich_pages(), t.side_files(), AS_OF, site_of=F.concat(F.lit("site-"), C("page_id")))
    return found.select("page_id", "check_id", C("score").cast("long").alias("score"), "status")


@query("selected_check_audit", _audit_sql(f"""
SELECT page_id, overall AS overall_score, passed, checks, CASE WHEN overall >= 80 THEN 'well optimised' WHEN overall >= 50 THEN 'needs work' ELSE 'hardly visible' END AS band
FROM (SELECT page_id, {_mean_sql("true")} AS overall, count_if(score >= {K.PASS_FROM}) AS passed, count(*) AS checks FROM c
  WHERE check_id IN ({", ".join(f"'{i}'" for i in K.PUBLIC_AUDIT_CHECKS)}) GROUP BY 1)"""))
def selected_check_audit(t):
    """The seven checks of the public audit, with the pass count and the band."""
    return audit_summary(audit_rows(
        t.rich_pages(), t.side_files(), AS_OF, K.PUBLIC_AUDIT_CHECKS, site_of=F.concat(F.lit("site-"), C("page_id"))))


@query("check_failure_isolation", """
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'error' ELSE 'pass' END AS status, CASE WHEN page_id % 9 = 0 THEN 0 ELSE 100 END AS score,
  CASE WHEN page_id % 9 = 0 THEN 0 ELSE 100 END AS overall_score FROM pages""")
def check_failure_isolation(t):
    """Unreadable pages (here: a null body) give status error and drop out of the average."""
    pages = t.pages().withColumn("html", F.when(C("page_id") % 9 != 0, C("html")))
    checks = audit_pages(pages, AS_OF, PAGE_CHECKS.subset(("performance",)))
    scores = scoring.scan_scores(checks, "page_id").select("page_id", "overall_score")
    return checks.select("page_id", "status", "score").join(scores, "page_id")


@query("site_info", r"""
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
  array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda h: trim(regexp_replace(h, '<[^>]+>', '', 'g'))), lambda h: h <> ''), '|') AS headings,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'),
    '(?is)<nav.*?</nav>', '', 'g'), '(?is)<footer.*?</footer>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body_text
FROM pages""")
def site_info_query(t):
    """Title, headings and body text for the artefact templates."""
    return site_info(t.pages()).select("page_id", "title", F.array_join("headings", "|").alias("headings"), "body_text")


