"""Series and window results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.catalog.metrics import _G, _graph
from sightline.catalog.views import sql
from sightline.functions import dates
from sightline.operators import series as S
from sightline.operators.skew import latest_per_key

C = F.col


@query("latest_scan_per_user", sql("""
SELECT user_id, scan_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scanned_at DESC, scan_id DESC) AS rn FROM scans) WHERE rn = 1""", "scans"))
def latest_scan_per_user(t):
    return latest_per_key(t.scans(), ["user_id"], ["scanned_at", "scan_id"]).select("user_id", "scan_id", "score")


@query("ranking_trend", sql("""
SELECT project_id, entity, ai_engine, day, rank_position FROM (SELECT *, coalesce(competitor_name, brand_name) AS entity, strftime(ranked_at, '%Y-%m-%d') AS day,
  row_number() OVER (PARTITION BY project_id, coalesce(competitor_name, brand_name), ai_engine, ranked_at::DATE ORDER BY ranked_at DESC, ranking_id DESC, rank_position DESC) AS rn FROM rankings) WHERE rn = 1""", "rankings"))
def ranking_trend(t):
    return S.ranking_trend(t.rankings())


@query("first_and_latest_scores", sql("""
SELECT project_id, arg_min(overall_score, (created_at, snapshot_id)) AS first_score, arg_max(overall_score, (created_at, snapshot_id)) AS latest_score,
  arg_min(overall_score, (created_at, snapshot_id)) FILTER (WHERE snapshot_type = 'baseline') AS baseline_score FROM score_snapshots GROUP BY 1""", "score_snapshots"))
def first_and_latest(t):
    return S.first_and_latest(t.score_snapshots())


_TREND = """CASE WHEN n < 2 THEN 'stable' WHEN f = 0 THEN CASE WHEN l > 0 THEN 'improving' WHEN l < 0 THEN 'declining' ELSE 'stable' END
  WHEN (l - f) / abs(f) > 0.05 THEN 'improving' WHEN (l - f) / abs(f) < -0.05 THEN 'declining' ELSE 'stable' END"""


@query("score_trends", sql(f"""
SELECT project_id, snapshot_id, {_TREND} AS trend FROM (SELECT project_id, snapshot_id, overall_score AS l, first_value(overall_score) OVER w AS f, count(*) OVER w AS n
FROM score_snapshots WINDOW w AS (PARTITION BY project_id ORDER BY created_at, snapshot_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""", "score_snapshots"))
def score_trends(t):
    return S.score_trends(t.score_snapshots(), "project_id", ["created_at", "snapshot_id"], "overall_score").select("project_id", "snapshot_id", "trend")


@query("latest_trends", sql(f"""
SELECT project_id, l AS latest_score, {_TREND} AS trend FROM (SELECT project_id, arg_min(overall_score, rn) AS l, arg_max(overall_score, rn) AS f, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM score_snapshots) WHERE rn <= 4 GROUP BY 1)""", "score_snapshots"))
def latest_trends(t):
    return S.latest_trends(t.score_snapshots(), "project_id", [F.desc("created_at"), F.desc("snapshot_id")], "overall_score")


@query("score_changes", sql("""
SELECT project_id, snapshot_id, previous, overall_score AS current, overall_score - previous AS delta, readiness_level FROM (
  SELECT *, lag(overall_score) OVER (PARTITION BY project_id ORDER BY created_at, snapshot_id) AS previous FROM score_snapshots) WHERE overall_score <> previous""", "score_snapshots"))
def score_changes(t):
    return S.score_changes(t.score_snapshots()).drop("created_at")


@query("milestones", sql("""
WITH p AS (SELECT *, coalesce(lag(overall_score) OVER (PARTITION BY project_id ORDER BY created_at, snapshot_id), 0) AS prev FROM score_snapshots),
b AS (SELECT project_id, arg_min(overall_score, (created_at, snapshot_id)) AS bs, arg_min(citations, (created_at, snapshot_id)) AS bc, min(created_at) AS bt FROM score_snapshots WHERE snapshot_type = 'baseline' GROUP BY 1),
j AS (SELECT p.*, bs, coalesce(bc, 0) AS bc, date_diff('day', bt, created_at) AS days, (overall_score - bs) * 100.0 / nullif(bs, 0) AS gain FROM p LEFT JOIN b USING (project_id)),
h AS (SELECT project_id, created_at, snapshot_id, 'score_threshold' AS milestone_type, s::VARCHAR AS milestone_key, overall_score AS current_value FROM j, (VALUES (25), (50), (75), (90)) t(s) WHERE overall_score >= s AND prev < s
  UNION ALL SELECT project_id, created_at, snapshot_id, 'citation_milestone', 'first', citations FROM j WHERE citations > 0 AND bc = 0
  UNION ALL SELECT project_id, created_at, snapshot_id, 'citation_milestone', 'doubled', citations FROM j WHERE bc > 0 AND citations >= bc * 2
  UNION ALL SELECT project_id, created_at, snapshot_id, 'citation_milestone', 'tenfold', citations FROM j WHERE bc > 0 AND citations >= bc * 10
  UNION ALL SELECT project_id, created_at, snapshot_id, 'improvement_rate', 'any', overall_score FROM j WHERE days BETWEEN 1 AND 60 AND gain >= 20
  UNION ALL SELECT project_id, min(queried_at), 0, 'first_mention', ai_engine, 1 FROM answers GROUP BY project_id, ai_engine)
SELECT project_id, milestone_type, milestone_key, strftime(arg_min(created_at, (created_at, snapshot_id)), '%Y-%m-%d') AS triggered, arg_min(current_value, (created_at, snapshot_id))::BIGINT AS current_value
FROM h WHERE NOT (project_id % 5 = 0 AND milestone_type = 'score_threshold' AND milestone_key = '50') GROUP BY 1, 2, 3""", "score_snapshots", "answers"))
def milestones(t):
    platforms = t.answers().select("project_id", C("ai_engine").alias("platform"), C("queried_at").alias("seen_at"))
    existing = t.score_snapshots().filter(C("project_id") % 5 == 0).select(
        "project_id", F.lit("score_threshold").alias("milestone_type"), F.lit("50").alias("milestone_key")).distinct()
    out = S.detect_milestones(t.score_snapshots(), platforms, existing)
    return out.select("project_id", "milestone_type", "milestone_key", dates.day(C("triggered_at")).alias("triggered"), C("current_value").cast("long").alias("current_value"))


@query("citation_snapshot_types", sql("""
WITH s AS (SELECT client_page_id, audit_id, count(*) AS total, max(extracted_at) AS captured_at FROM mappings JOIN citations USING (citation_id) JOIN cited_pages USING (cited_page_id)
  WHERE client_page_id IS NOT NULL GROUP BY 1, 2)
SELECT client_page_id, audit_id, total, CASE WHEN row_number() OVER (PARTITION BY client_page_id ORDER BY captured_at, audit_id) = 1 THEN 'before' ELSE 'after' END AS snapshot_type FROM s""", *_G))
def citation_snapshot_types(t):
    s = _graph(t).filter(C("client_page_id").isNotNull()).groupBy("client_page_id", "audit_id").agg(
        F.count(F.lit(1)).alias("total"), F.max("extracted_at").alias("captured_at"))
    return S.snapshot_types(s).drop("captured_at")


@query("plan_changes", """
WITH s AS (SELECT o_custkey AS user_id, ['free','starter','pro','agency','enterprise'][o_orderkey % 5 + 1] AS plan, o_orderkey % 5 AS r, o_orderdate, o_orderkey FROM orders),
l AS (SELECT *, lag(plan) OVER w AS previous_plan, lag(r) OVER w AS pr FROM s WINDOW w AS (PARTITION BY user_id ORDER BY o_orderdate, o_orderkey))
SELECT user_id, o_orderkey, previous_plan, plan, CASE WHEN r > pr THEN 'upgrade' WHEN r < pr THEN 'downgrade' ELSE 'same' END AS transition,
  pr = 0 AND r > 0 AS requires_checkout, r = 0 AND pr > 0 AS requires_cancellation, plan = 'enterprise' OR previous_plan = 'enterprise' AS requires_contact FROM l WHERE previous_plan IS NOT NULL""")
def plan_changes(t):
    plan = F.element_at(F.array(*[F.lit(p) for p in ("free", "starter", "pro", "agency", "enterprise")]), (C("o_orderkey") % 5 + 1).cast("int"))
    s = t.raw("orders").select(C("o_custkey").alias("user_id"), plan.alias("plan"), "o_orderdate", "o_orderkey")
    return S.plan_changes(s, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("score_histories", sql("""
SELECT project_id, string_agg(score, ',' ORDER BY week) AS history FROM (SELECT project_id, date_trunc('week', created_at) AS week, arg_max(overall_score, (created_at, snapshot_id)) AS score
FROM score_snapshots WHERE created_at >= DATE '2001-08-01' - 364 AND created_at < DATE '2001-08-02' GROUP BY 1, 2) GROUP BY 1""", "score_snapshots"))
def score_histories(t):
    return S.weekly_history(t.score_snapshots(), "project_id", 52, "2001-08-01").select("project_id", F.array_join(C("history").cast("array<string>"), ",").alias("history"))


@query("locale_deltas", sql("""
SELECT user_id, locale, score, score - p AS delta FROM (SELECT *, lag(score) OVER w AS p, row_number() OVER (PARTITION BY user_id, locale ORDER BY scanned_at DESC, scan_id DESC) AS rn
FROM scans WINDOW w AS (PARTITION BY user_id, locale ORDER BY scanned_at, scan_id)) WHERE rn = 1""", "scans"))
def locale_deltas(t):
    return S.locale_deltas(t.scans())


@query("heading_skips", sql("""
WITH h AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<h([1-6])', 1), lambda x, i: {'p': i, 'l': x::INT})) AS e FROM rich_pages),
l AS (SELECT page_id, e.p AS position, e.l AS level, lag(e.l) OVER (PARTITION BY page_id ORDER BY e.p) AS previous_level FROM h)
SELECT page_id, level, previous_level FROM l WHERE level > previous_level + 1""", "rich_pages"))
def heading_skips(t):
    levels = F.regexp_extract_all("html", F.lit("<h([1-6])"), F.lit(1))
    h = t.rich_pages().select("page_id", F.posexplode(levels).alias("position", "level")).withColumn("level", C("level").cast("int"))
    return S.heading_skips(h).select("page_id", "level", "previous_level")
