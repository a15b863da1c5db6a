"""Extracts and keyed writes as results."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from sightline import constants as K
from sightline.catalog import query
from sightline.catalog.views import sql
from sightline.operators import artefacts as A
from sightline.operators.scoring import level_of
from sightline.session import checkpoint_dir
from sightline.sources import sinks as S

C = F.col


def _scan_export(t):
    reg = S.ExporterRegistry()
    rows = lambda: t.scans().select(
        F.concat(F.lit('a "quoted" '), "domain").alias("label"), "scanned_at", "score", F.struct("locale").alias("details"))
    reg.register("scans", rows, ["label", "scanned_at", "score", "details"], ["label", "score"], "scanned_at")
    return reg.export("scans", ["label", "scanned_at", "score", "details"], datetime(1996, 1, 1), datetime(1996, 12, 31))


@query("csv_export", sql("""
SELECT '"' || 'a ""quoted"" ' || domain || '",' || strftime(scanned_at, '%Y-%m-%dT%H:%M:%S.000Z') || ',' || score || ',"{""locale"":""' || locale || '""}"' AS value
FROM scans WHERE scanned_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""", "scans"))
def csv_export(t):
    """CSV lines of an export: allowed columns, a date range, quotes, ISO dates and JSON."""
    return S.csv_lines(_scan_export(t))


@query("csv_files", sql("""
SELECT 'a "quoted" ' || domain AS label, strftime(scanned_at, '%Y-%m-%dT%H:%M:%S.000Z') AS scanned_at, score::VARCHAR AS score, '{"locale":"' || locale || '"}' AS details
FROM scans WHERE scanned_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' UNION ALL SELECT chr(65279) || 'label', 'scanned_at', 'score', 'details' || chr(13) || chr(10)""", "scans"))
def csv_files(t):
    """The export as files, read back: the rows through the CSV reader, the header file as it stands, with byte-order mark and line end."""
    path = f"{checkpoint_dir(t.spark)}/csv-{uuid4().hex}"
    columns = ["label", "scanned_at", "score", "details"]
    S.write_csv(_scan_export(t), path)
    rows = t.spark.read.option("lineSep", "\r\n").option("escape", '"').schema(", ".join(f"{c} string" for c in columns)).csv(f"{path}/part=1")
    head = t.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/part=0").select(F.decode("content", "utf-8").alias("value"))
    header = head.select(*[F.split_part("value", F.lit(","), F.lit(k + 1)).alias(c) for k, c in enumerate(columns)])
    return rows.unionByName(header)


@query("bi_extract", sql("""
WITH rivals AS (SELECT DISTINCT 'site' || c_custkey % 200 || '.example' AS domain, 'rival' || c_custkey // 200 % 2 || '.example' AS competitor_domain FROM customer WHERE c_custkey % 5 <> 0),
held AS (SELECT 'site' || c_custkey % 200 || '.example' AS domain, count(*) AS n FROM customer WHERE c_nationkey < 12 GROUP BY 1)
SELECT scan_id, domain, strftime(scanned_at, '%Y%m%d') AS scan_date, split_part(locale, '-', 2) AS locale_country, split_part(locale, '-', 1) AS locale_language, competitor_domain, status,
  score AS readiness_score, (CASE WHEN score <= 20 THEN 0 WHEN score <= 50 THEN 1 WHEN score <= 75 THEN 2 ELSE 3 END)::INT AS readiness_level,
  coalesce(c.n, 0) AS citation_count, coalesce(f.n, 0) AS fix_count, coalesce(r.n, 0) AS competitor_count, coalesce(held.n, 0) AS locale_count
FROM scans LEFT JOIN rivals USING (domain) LEFT JOIN (SELECT l_orderkey AS scan_id, count(*) AS n FROM lineitem GROUP BY 1) f USING (scan_id)
  LEFT JOIN (SELECT event_id AS scan_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) c USING (scan_id)
  LEFT JOIN (SELECT domain, count(*) AS n FROM rivals GROUP BY 1) r USING (domain) LEFT JOIN held USING (domain)""", "scans"))
def bi_extract(t):
    """All thirteen fields; a scan has a row for each competitor of its domain."""
    domain = F.concat(F.lit("site"), C("c_custkey") % 200, F.lit(".example")).alias("domain")
    rivals = t.raw("customer").filter(C("c_custkey") % 5 != 0).select(
        domain, F.concat(F.lit("rival"), F.floor(C("c_custkey") / 200) % 2, F.lit(".example")).alias("competitor_domain")).distinct()
    scans = t.scans().withColumn("readiness_level", level_of(C("score"))).join(rivals, "domain", "left")
    return S.bi_extract(scans, {
        "fix_count": (t.raw("lineitem").select(C("l_orderkey").alias("scan_id")), "scan_id"),
        "citation_count": (t.raw("events").filter(C("event_type") == "click").select(C("event_id").alias("scan_id")), "scan_id"),
        "competitor_count": (rivals, "domain"), "locale_count": (t.raw("customer").filter(C("c_nationkey") < 12).select(domain), "domain"),
    }, list(K.BI_FIELDS))


@query("insert_absent", sql("SELECT queue, job_id FROM (SELECT queue, min(job_id) AS job_id FROM job_log WHERE state = 'failed' GROUP BY queue, job_id // 3) j WHERE NOT EXISTS (SELECT 1 FROM job_log k WHERE k.queue = j.queue AND k.job_id // 3 = j.job_id // 3 AND k.state = 'completed')", "job_log"))
def insert_absent(t):
    k = F.floor(C("job_id") / 3).alias("key")
    batch = t.job_log().filter(C("state") == "failed").select("queue", k, "job_id")
    target = t.job_log().filter(C("state") == "completed").select("queue", k)
    return S.insert_absent(target, batch, ["queue", "key"], ["job_id"]).select("queue", "job_id")


@query("upsert_keep_link", sql("""
WITH o AS (SELECT cited_page_id AS id, domain, client_page_id FROM cited_pages), n AS (SELECT cited_page_id + 5 AS id, 'new' AS domain, cited_page_id AS client_page_id FROM cited_pages WHERE cited_page_id % 2 = 0)
SELECT id, coalesce(n.domain, o.domain) AS domain, coalesce(o.client_page_id, n.client_page_id) AS client_page_id FROM o FULL JOIN n USING (id)""", "cited_pages"))
def upsert_keep_link(t):
    old = t.cited_pages().select(C("cited_page_id").alias("id"), "domain", "client_page_id")
    new = t.cited_pages().filter(C("cited_page_id") % 2 == 0).select(
        (C("cited_page_id") + 5).alias("id"), F.lit("new").alias("domain"), C("cited_page_id").alias("client_page_id"))
    return S.upsert(old, new, ["id"], keep=("client_page_id",))


@query("upsert_partitions", sql("""
WITH o AS (SELECT cited_page_id AS id, domain, client_page_id FROM cited_pages), n AS (SELECT cited_page_id + 5 AS id, 'new' AS domain, cited_page_id AS client_page_id FROM cited_pages WHERE cited_page_id % 2 = 0)
SELECT id, coalesce(n.domain, o.domain) AS domain, coalesce(o.client_page_id, n.client_page_id) AS client_page_id FROM o FULL JOIN n USING (id)""", "cited_pages"))
def upsert_partitions(t):
    """A stored table after a batch that came twice, read back."""
    path = f"{checkpoint_dir(t.spark)}/keyed-{uuid4().hex}"
    S.write_keyed(t.cited_pages().select(C("cited_page_id").alias("id"), "domain", "client_page_id"), path, ["id"], 8)
    batch = t.cited_pages().filter(C("cited_page_id") % 2 == 0).select(
        (C("cited_page_id") + 5).alias("id"), F.lit("new").alias("domain"), C("cited_page_id").alias("client_page_id"))
    for _ in range(2):
        S.upsert_keyed(path, batch, ["id"], ("client_page_id",), 8)
    return t.spark.read.parquet(path).select("id", "domain", "client_page_id")


@query("merged_json", """
WITH p AS (SELECT user_id, event_type AS field, json_extract_string(props, '$.k') AS v, event_id FROM events),
l AS (SELECT user_id, field, arg_max(v, event_id) AS v FROM p GROUP BY 1, 2),
u AS (SELECT user_id, field, v FROM l UNION ALL SELECT c_custkey, 'base', '0' FROM customer)
SELECT user_id, '{' || string_agg('"' || field || '":"' || v || '"', ',' ORDER BY field) || '}' AS doc, count(*)::INT AS field_count FROM u GROUP BY 1""")
def merged_json(t):
    """JSON objects merged per key, the last write of a field winning."""
    target = t.raw("customer").select(C("c_custkey").alias("user_id"), F.lit('{"base":"0"}').alias("doc"))
    patches = t.raw("events").select(
        "user_id", F.concat(F.lit('{"'), "event_type", F.lit('":"'), F.get_json_object("props", "$.k"), F.lit('"}')).alias("patch"), "event_id")
    return S.merge_json(target, patches, "user_id", ["event_id"])


@query("event_fan_out", """
SELECT event_id, s_suppkey AS endpoint_id, '{"id":"' || event_id || '","type":"' || event_type || '","createdAt":"' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","data":' || replace(props, ' ', '') || '}' AS payload
FROM events JOIN supplier ON s_suppkey // 2 = user_id AND s_suppkey % 3 <> 0 AND CASE event_type WHEN 'click' THEN s_suppkey % 2 = 0 WHEN 'error' THEN true WHEN 'view' THEN s_suppkey % 5 = 0 ELSE false END""")
def event_fan_out(t):
    """Every event to the endpoints of its user; two suppliers stand for the endpoints of each."""
    k = C("s_suppkey")
    kinds = F.concat(F.array(F.lit("error"), F.lit("error")), *[F.when(k % n == 0, F.array(F.lit(x))).otherwise(F.array().cast("array<string>")) for n, x in ((2, "click"), (5, "view"))])
    endpoints = t.raw("supplier").select(k.alias("endpoint_id"), F.floor(k / 2).alias("user_id"), kinds.alias("events"), (k % 3 != 0).alias("is_active"))
    events = t.raw("events").select("event_id", "user_id", "event_type", C("ts").alias("created_at"), C("props").alias("data"))
    return S.fan_out(events, endpoints, ("user_id",)).select("event_id", "endpoint_id", "payload")


@query("content_versions", """
WITH b AS (SELECT event_id, user_id AS scan_id, event_type AS kind, props AS content FROM events),
f AS (SELECT scan_id, kind, content, min(event_id) AS event_id FROM b GROUP BY 1, 2, 3)
SELECT scan_id, kind, event_id, row_number() OVER (PARTITION BY scan_id, kind ORDER BY event_id) + CASE WHEN scan_id IN (SELECT c_custkey FROM customer) AND kind = 'click' THEN 4 ELSE 0 END AS version FROM f
WHERE NOT (scan_id IN (SELECT c_custkey FROM customer) AND kind = 'click' AND content = '{"k": 1}')""")
def content_versions(t):
    """New versions of changed content per (scan, kind); known content is skipped."""
    batch = t.raw("events").select(C("user_id").alias("scan_id"), C("event_type").alias("kind"), "event_id", C("props").alias("content"), C("props").alias("input_hash"))
    store = t.raw("customer").select(
        C("c_custkey").alias("scan_id"), F.lit("click").alias("kind"), F.lit(4).alias("version"),
        S.content_hash(F.lit('{"k": 1}')).alias("content_hash"), F.lit("none").alias("input_hash"))
    return S.next_versions(store, batch, ["scan_id", "kind"], ["event_id"]).select("scan_id", "kind", "event_id", "version")


_LINE = "trim(regexp_replace(translate({}, '<>[]', '    '), '\\s+', ' ', 'g'))"
_INFO = rf"""i AS (SELECT page_id, url, coalesce(nullif({_LINE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''), host) AS name,
  coalesce(nullif({_LINE.format("""regexp_extract(html, '(?i)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1)""")}, ''), 'Pages published at ' || host) AS about,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]+') AS origin,
  list_transform(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda h: trim(regexp_replace(h, '<[^>]+>', '', 'g'))), lambda h: h <> ''), lambda h: '- ' || {_LINE.format('h')}) AS items
  FROM (SELECT *, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages))"""


def _joined(*parts: str) -> str:
    return "array_to_string([" + ", ".join(x if x.startswith(("'", "CASE")) or "||" in x or x == "about" else "'" + x + "'" for x in parts) + "], chr(10))"


@query("fix_artefacts", f"""
WITH {_INFO} SELECT page_id, 'llms_txt' AS artefact, {_joined("'# ' || name", "", "'> ' || about", "", "## Where to start", "",
    "'- [Source page](' || url || '): the page that this list was made from'", "'- [Site root](' || origin || '/): entrance to everything else on the host'", "",
    "## Subjects of the source page", "", "CASE WHEN len(items) > 0 THEN array_to_string(items, chr(10)) ELSE 'The source page has no headings.' END", "", "## Before publishing", "",
    "Put the pages that readers need most under the first heading, one link a line, and say behind each link what it answers. Remove what is out of date.", "")} AS content, true AS valid FROM i
UNION ALL SELECT page_id, 'agents_md', {_joined("'# ' || name || ': notes for software agents'", "", "about", "", "## What an agent finds here", "",
    "CASE WHEN len(items) > 0 THEN array_to_string(items, chr(10)) ELSE 'The page has no headings.' END", "", "## Allowed actions", "",
    "'- read ' || url || ' and the pages it links to on this host'", "- quote passages together with the address they came from", "- summarise, as long as the summary names its source", "",
    "## Not allowed", "", "- keeping personal data found on a page", "- sending forms without the consent of the person who asked", "", "## To be completed by the owner", "",
    "'- contact address for questions about ' || origin || '/'", "- link to the terms of use", "- endpoints beyond plain pages, with an example of each", "")}, true FROM i
UNION ALL SELECT page_id, 'json_ld', '{{"@context":"https://schema.org","@graph":[{{"@type":"Organization","name":' || to_json(name) || ',"url":' || to_json(origin) || ',"description":' || to_json(about)
  || '}},{{"@type":"WebSite","name":' || to_json(name) || ',"url":' || to_json(origin) || '}}]}}', true FROM i""")
def fix_artefacts(t):
    """Rule-made artefacts of every page, with their texts, held to the bar of the checks."""
    info = A.site_info(t.pages())
    made = A.llms_fix(info).unionByName(A.json_ld_fix(info)).unionByName(A.agents_fix(info))
    return A.validate_artefacts(made).select("page_id", "artefact", "content", "valid")


@query("robots_fixes", sql(r"""
SELECT site, 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || chr(10)
  || list_reduce(list_prepend('', list_transform(list_filter(['GPTBot','ChatGPT-User','ClaudeBot','Claude-Web','PerplexityBot','Google-Extended'], lambda b: CASE k % 5 WHEN 0 THEN false WHEN 1 THEN b = 'GPTBot' WHEN 3 THEN b <> 'ClaudeBot' ELSE true END), lambda b: 'User-agent: ' || b || chr(10) || 'Allow: /' || chr(10) || chr(10))), lambda a, b: a || b)
  || 'Sitemap: ' || CASE WHEN k % 5 = 0 THEN regexp_extract(robots, 'Sitemap: (.*)', 1) ELSE 'https://' || site || '.example/sitemap.xml' END AS content
FROM side_files WHERE robots IS NOT NULL""", "side_files"))
def robots_fixes(t):
    from sightline.operators.site_checks import add_robots_groups, bot_access, site_files

    files = site_files(t.side_files()).filter(C("robots").isNotNull()).select("site", "robots")
    access = bot_access(files).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("bot", "access"))).alias("bots"))
    parsed = add_robots_groups(files).select("site", C("robots_sitemaps").alias("sitemaps"), F.concat(F.lit("https://"), "site", F.lit(".example")).alias("origin"))
    return A.robots_fix(parsed.join(access, "site")).select("site", "content")


@query("deployed_content", """
SELECT page_id AS deployment_id, CASE WHEN page_id % 6 = 5 THEN 'fail' WHEN page_id % 3 = 0 THEN 'pass' ELSE 'partial' END AS status FROM pages""")
def deployed_content(t):
    """Deployed files against what was meant to be deployed."""
    info = A.site_info(t.pages())
    k = C("deployment_id")
    made = A.llms_fix(info).select(C("page_id").alias("deployment_id"), C("artefact").alias("fix_type"), C("content").alias("expected"))
    body = F.when(k % 3 == 0, F.concat(F.lit("<pre> "), F.replace("expected", F.lit("\n"), F.lit("\r\n")), F.lit("</pre>"))).otherwise(F.lit("# Other"))
    fetched = made.select("deployment_id", F.when(k % 6 == 5, 404).otherwise(200).alias("http_status"), body.alias("body"))
    return A.deployed_content(made, fetched).select("deployment_id", "status")


@query("deployed_json_ld", """SELECT page_id AS deployment_id, CASE page_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'partial' ELSE 'fail' END AS status FROM pages""")
def deployed_json_ld(t):
    info = A.site_info(t.pages())
    k = C("deployment_id")
    made = A.json_ld_fix(info).select(C("page_id").alias("deployment_id"), C("artefact").alias("fix_type"), C("content").alias("expected"))
    block = lambda x: F.concat(F.lit('<script type="application/ld+json"> '), x, F.lit("</script>"))
    body = F.when(k % 3 == 0, F.concat(block(F.lit("{bad")), block(F.col("expected")))).when(k % 3 == 1, block(F.lit('{"a": 1}'))).otherwise(F.lit("<p>none</p>"))
    return A.deployed_content(made, made.select("deployment_id", F.lit(200).alias("http_status"), body.alias("body"))).select("deployment_id", "status")
