"""Ordered pages of lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.catalog.views import sql
from sightline.operators import paging as P

C = F.col


@query("mention_page", sql("""
SELECT mention_id, brand_name FROM mentions WHERE project_id = 3 AND sentiment IN ('positive', 'neutral') AND (mentioned_at < TIMESTAMP '2024-01-20' OR (mentioned_at = TIMESTAMP '2024-01-20' AND mention_id < 5000))
ORDER BY mentioned_at DESC, mention_id DESC LIMIT 21""", "mentions"))
def mention_page(t):
    """Second page of a mention list by cursor."""
    rows = t.mentions().filter((C("project_id") == 3) & C("sentiment").isin("positive", "neutral"))
    return P.keyset_page(rows, "mentioned_at", "mention_id", 20, (datetime(2024, 1, 20), 5000)).select("mention_id", "brand_name")


@query("mentions_by_sentiment", sql("""
SELECT mention_id, sentiment FROM mentions WHERE project_id = 1 ORDER BY CASE sentiment WHEN 'positive' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END DESC, mentioned_at DESC, mention_id DESC LIMIT 50""", "mentions"))
def mentions_by_sentiment(t):
    return t.mentions().filter(C("project_id") == 1).orderBy(*P.mention_order("sentiment", "desc")).limit(50).select("mention_id", "sentiment")


@query("mentions_by_engine", sql("""
SELECT mention_id, ai_engine FROM mentions LEFT JOIN answers USING (snapshot_id) WHERE mentions.project_id = 1 ORDER BY ai_engine DESC NULLS FIRST, mentioned_at DESC, mention_id DESC LIMIT 40""", "mentions", "answers"))
def mentions_by_engine(t):
    j = t.mentions().filter(C("project_id") == 1).join(t.answers().select("snapshot_id", "ai_engine"), "snapshot_id", "left")
    return j.orderBy(*P.mention_order("model", "desc")).limit(40).select("mention_id", "ai_engine")


@query("dead_letter_page", sql("SELECT job_id, queue FROM job_log WHERE state = 'failed' ORDER BY ts DESC, job_id DESC LIMIT 25 OFFSET 50", "job_log"))
def dead_letter_page(t):
    rows = t.job_log().filter(C("state") == "failed")
    return P.offset_page(rows, [F.desc("ts"), F.desc("job_id")], 50, 25).select("job_id", "queue")


@query("top_engine", sql("""
SELECT ai_engine, count(*) AS mentions FROM mentions JOIN answers USING (snapshot_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""", "mentions", "answers"))
def top_engine(t):
    j = t.mentions().join(t.answers().select("snapshot_id", "ai_engine"), "snapshot_id")
    return j.groupBy("ai_engine").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "ai_engine").limit(1)


@query("distinct_cited_pages", sql("""
SELECT DISTINCT audit_id, domain, model_name FROM mappings JOIN citations USING (citation_id) JOIN cited_pages USING (cited_page_id)""", "mappings", "citations", "cited_pages"))
def distinct_cited_pages(t):
    from sightline.operators.metrics import citation_graph

    return citation_graph(t.citations(), t.mappings(), t.cited_pages()).select("audit_id", "domain", "model_name").distinct()


@query("latest_scan_per_locale", sql("""
SELECT domain, locale, scan_id FROM (SELECT *, row_number() OVER (PARTITION BY domain, locale ORDER BY scanned_at DESC, scan_id DESC) AS rn FROM scans) WHERE rn = 1""", "scans"))
def latest_scan_per_locale(t):
    return P.latest_per_locale(t.scans()).select("domain", "locale", "scan_id")


@query("unioned_match_streams", sql("""
SELECT audit_id AS id, 'citation' AS kind FROM citations UNION ALL SELECT project_id, 'mention' FROM mentions UNION ALL SELECT project_id, 'ranking' FROM rankings""", "citations", "mentions", "rankings"))
def unioned(t):
    """Rows of three kinds in one table."""
    kind = lambda df, c, k: df.select(C(c).alias("id"), F.lit(k).alias("kind"))
    return kind(t.citations(), "audit_id", "citation").unionByName(kind(t.mentions(), "project_id", "mention")).unionByName(
        kind(t.rankings(), "project_id", "ranking"))


@query("list_request", sql("SELECT scan_id, domain, score FROM scans WHERE status = 'completed' AND locale = 'fr-FR' ORDER BY score DESC NULLS FIRST, scan_id LIMIT 31", "scans"))
def list_request(t):
    fields = ["scan_id", "domain", "score", "status", "locale", "scanned_at"]
    request = P.parse_list_request(
        {"limit": "30", "fields": "scan_id,domain,score", "sort": "-score", "status": "completed", "locale": "fr-FR"}, fields, ["score", "scanned_at"])
    return P.run_list_request(t.scans(), request, "scan_id")


@query("cursor_tags", "SELECT event_id, sha256(encode(props)) AS hash, replace(replace(rtrim(base64(encode(props)), '='), '+', '-'), '/', '_') AS token FROM events")
def cursor_tags(t):
    """SHA-256 and URL-safe base64 of row payloads."""
    from sightline.functions.json_text import base64url

    return t.raw("events").select("event_id", F.sha2("props", 256).alias("hash"), base64url(F.encode("props", "utf-8")).alias("token"))


@query("string_distances", "SELECT a.n_nationkey AS a, b.p_partkey AS b, levenshtein(a.n_name, 'NATION_' || b.p_size) AS distance FROM nation a JOIN part b ON a.n_nationkey = b.p_partkey % 25")
def string_distances(t):
    n = t.raw("nation").select(C("n_nationkey").alias("a"), "n_name")
    p = t.raw("part").select(C("p_partkey").alias("b"), (C("p_partkey") % 25).alias("a"), F.concat(F.lit("NATION_"), "p_size").alias("x"))
    return p.join(n, "a").select("a", "b", F.levenshtein("n_name", "x").alias("distance"))


@query("masked_payloads", """SELECT event_id, '{"email":"[REDACTED]","k":' || json_extract_string(props, '$.k') || ',"name":"[REDACTED]","list":[{"IP":"[REDACTED]","x":1},[{"deep":{"Email":"[REDACTED]"}}]],"note":"\\"ip\\":\\"' || user_id || '\\""}' AS payload FROM events""")
def masked_payloads(t):
    """Personal fields of JSON payloads replaced."""
    from sightline.functions.json_text import mask_keys

    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{"email":"u'), "user_id", F.lit('@x.example","k":'), k, F.lit(',"name":{"first":{"given":"a","family":"b"},"x":[1,{"y":2}]},"list":[{"IP":["1",{"a":1}],"x":1},[{"deep":{"Email":null}}]],"note":"\\"ip\\":\\"'), "user_id", F.lit('\\""}'))
    return t.raw("events").select("event_id", mask_keys(raw, ("email", "name", "ip")).alias("payload"))


@query("calendar_fields", """
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ymd, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, date_diff('day', o_orderdate, TIMESTAMP '2001-08-01')::INT AS age, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS next_week FROM orders""")
def calendar_fields(t):
    d = C("o_orderdate")
    return t.raw("orders").select(
        "o_orderkey", F.date_format(d, "yyyyMMdd").alias("ymd"), F.date_format(F.date_trunc("week", d), "yyyy-MM-dd").alias("week"),
        F.datediff(F.to_date(F.lit("2001-08-01")), d).alias("age"), F.date_format(F.date_add(d, 7), "yyyy-MM-dd").alias("next_week"))


@query("value_statistics", """
SELECT event_type, round(stddev_pop(value), 6) AS deviation, floor(avg(value) * 10 + 0.5) / 10 AS mean, round(count_if(value > 400) / count(*), 6) AS share, least(100, greatest(0, floor(max(value) - 400)))::BIGINT AS clamped FROM events GROUP BY 1""")
def value_statistics(t):
    from sightline.functions.numbers import clamp, round_half_up

    v = C("value")
    return t.raw("events").groupBy("event_type").agg(
        F.round(F.stddev_pop(v), 6).alias("deviation"), round_half_up(F.avg(v), 1).alias("mean"),
        F.round(F.try_divide(F.count_if(v > 400), F.count(F.lit(1))), 6).alias("share"), clamp(F.floor(F.max(v) - 400)).alias("clamped"))


@query("map_and_array_fields", """
WITH a AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT o_custkey, statuses, f + o AS known, f AS finished FROM a""")
def map_and_array_fields(t):
    """Arrays and maps of a bounded set of states."""
    counts = t.raw("orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    m = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    get = lambda k: F.coalesce(F.try_element_at(C("m"), F.lit(k)), F.lit(0))
    return m.select("o_custkey", F.array_join(F.array_sort(F.map_keys("m")), "").alias("statuses"), (get("F") + get("O")).alias("known"), get("F").alias("finished"))
