"""Scores of scans and comparisons between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import constants as K
from sightline.catalog import query
from sightline.catalog.views import sql
from sightline.operators import scoring as S
from sightline.operators.metrics import where

C = F.col

_R = "floor(sum(w * least(100, greatest(0, score))){f}::DOUBLE / nullif(sum(w){f}, 0) + 0.5)::INT"


def _w(condition: str = "true") -> str:
    return _R.replace("{f}", f" FILTER (WHERE {condition})")


_FUTURE = "check_id IN ('llms-txt','webmcp','agents-md')"
_SCORED = f"""
okc AS (SELECT scan_id, check_id, score, weight AS w, category FROM check_results JOIN check_dim USING (check_id) WHERE status <> 'error'),
allc AS (SELECT DISTINCT scan_id FROM check_results),
sc AS (SELECT scan_id, coalesce({_w()}, 0) AS overall_score, {_w("category = 'readability'")} AS readability, {_w("category = 'interactivity'")} AS interactivity,
  coalesce({_w(f'NOT {_FUTURE}')}, 0) AS current_readiness, coalesce({_w(_FUTURE)}, 0) AS future_readiness,
  bool_and(score >= 50) FILTER (WHERE check_id = 'robots-txt') AS g1, bool_and(score >= 50) FILTER (WHERE check_id IN ('robots-txt','meta-tags')) AS g2,
  bool_and(score >= 50) FILTER (WHERE check_id IN ('robots-txt','meta-tags','llms-txt','schema-org','content-structure')) AS g3
  FROM okc RIGHT JOIN allc USING (scan_id) GROUP BY 1),
scored AS (SELECT scan_id, overall_score, readability, interactivity, NULL::INT AS transactional, current_readiness, future_readiness,
  least(CASE WHEN overall_score <= 20 THEN 0 WHEN overall_score <= 50 THEN 1 WHEN overall_score <= 75 THEN 2 ELSE 3 END,
    CASE WHEN NOT coalesce(g1, true) THEN 0 WHEN NOT coalesce(g2, true) THEN 1 WHEN NOT coalesce(g3, true) THEN 2 ELSE 3 END) AS readiness_level FROM sc)
"""
_V = ("check_dim", "check_results")


def _q(body: str, *more: str) -> str:
    """SQL over the scored checks; a body that starts with a comma goes on with more named parts."""
    return sql(f"WITH {_SCORED.strip()}{body.strip() if body.startswith(',') else chr(10) + body}", *_V, *more)


def _scores(t):
    return S.scan_scores(t.check_results())


@query("overall_scores", _q("SELECT scan_id, overall_score FROM scored"))
def overall_scores(t):
    return _scores(t).select("scan_id", "overall_score")


@query("category_scores", _q("SELECT scan_id, readability, interactivity, transactional FROM scored"))
def category_scores(t):
    return _scores(t).select("scan_id", *K.CATEGORIES)


@query("readiness_levels", _q("SELECT scan_id, readiness_level FROM scored"))
def readiness_levels(t):
    return _scores(t).select("scan_id", "readiness_level")


@query("current_and_future_readiness", _q("SELECT scan_id, current_readiness, future_readiness FROM scored"))
def readiness(t):
    return _scores(t).select("scan_id", "current_readiness", "future_readiness")


@query("score_breakdown", _q("""
SELECT scan_id, check_id, least(100, greatest(0, score)) AS score, w AS weight, CASE WHEN tw > 0 THEN floor(least(100, greatest(0, score)) * w * 100.0 / tw + 0.5) / 100 ELSE 0 END AS weighted_score, tw AS total_weight
FROM (SELECT *, (sum(w) OVER (PARTITION BY scan_id))::BIGINT AS tw FROM okc)"""))
def score_breakdown(t):
    return S.score_breakdown(t.check_results())


def _pairs(t, a, b):
    """Every scan against the next one."""
    ids = t.check_results().select("scan_id").distinct()
    return ids.select(C("scan_id").alias(a), (C("scan_id") + 1).alias(b)).join(ids.select(C("scan_id").alias(b)), b, "left_semi")


_PAIRS = "prs AS (SELECT scan_id AS a, scan_id + 1 AS b FROM allc WHERE scan_id + 1 IN (SELECT scan_id FROM allc))"


@query("check_comparison", _q(f""", {_PAIRS} SELECT a AS primary_id, b AS competitor_id, x.check_id, x.score AS primary_score, y.score AS competitor_score, x.score - y.score AS delta,
CASE WHEN x.score > y.score THEN 'won' WHEN x.score < y.score THEN 'lost' ELSE 'tied' END AS result FROM prs JOIN okc x ON x.scan_id = a JOIN okc y ON y.scan_id = b AND y.check_id = x.check_id"""))
def check_comparison(t):
    return S.compare_checks(t.check_results(), _pairs(t, "primary_id", "competitor_id"))


@query("category_comparison", _q(f""", {_PAIRS}, long AS (UNPIVOT (SELECT scan_id, coalesce(readability, -1) AS readability, coalesce(interactivity, -1) AS interactivity, -1 AS transactional FROM scored) ON readability, interactivity, transactional INTO NAME category VALUE s),
lg AS (SELECT scan_id, category, nullif(s, -1) AS s FROM long)
SELECT a AS primary_id, b AS competitor_id, x.category, x.s AS primary_score, y.s AS competitor_score, coalesce(x.s, 0) - coalesce(y.s, 0) AS delta,
  CASE WHEN coalesce(x.s, 0) > coalesce(y.s, 0) THEN 'won' WHEN coalesce(x.s, 0) < coalesce(y.s, 0) THEN 'lost' ELSE 'tied' END AS result
FROM prs JOIN lg x ON x.scan_id = a JOIN lg y ON y.scan_id = b AND y.category = x.category"""))
def category_comparison(t):
    return S.compare_categories(_scores(t), _pairs(t, "primary_id", "competitor_id"))


@query("comparison_summary", _q(f""", {_PAIRS}, d AS (SELECT a, b, x.score - y.score AS delta FROM prs JOIN okc x ON x.scan_id = a JOIN okc y ON y.scan_id = b AND y.check_id = x.check_id),
n AS (SELECT a, b, count_if(delta > 0) AS w, count_if(delta < 0) AS l, count_if(delta = 0) AS t FROM d GROUP BY 1, 2)
SELECT a AS primary_id, b AS competitor_id, x.overall_score AS primary_overall, y.overall_score AS competitor_overall, x.overall_score - y.overall_score AS overall_delta,
  coalesce(w, 0) AS checks_won, coalesce(l, 0) AS checks_lost, coalesce(t, 0) AS checks_tied
FROM prs JOIN scored x ON x.scan_id = a JOIN scored y ON y.scan_id = b LEFT JOIN n USING (a, b)"""))
def comparison_summary(t):
    pairs = _pairs(t, "primary_id", "competitor_id")
    return S.comparison_summary(S.compare_checks(t.check_results(), pairs), _scores(t), pairs)


@query("snapshot_check_deltas", _q(f""", {_PAIRS}, f AS (SELECT a, b, check_id, score FROM prs JOIN okc ON scan_id = a), l AS (SELECT a, b, check_id, score FROM prs JOIN okc ON scan_id = b)
SELECT a AS before_id, b AS after_id, check_id, f.score AS before_score, l.score AS after_score, l.score - f.score AS delta, CASE WHEN f.score <> 0 THEN floor((l.score - f.score) * 100.0 / f.score * 100 + 0.5) / 100 END AS percent,
  CASE WHEN f.score IS NULL THEN 'added' WHEN l.score IS NULL THEN 'removed' WHEN l.score > f.score THEN 'improved' WHEN l.score < f.score THEN 'regressed' ELSE 'unchanged' END AS change
FROM f FULL JOIN l USING (a, b, check_id)"""))
def snapshot_check_deltas(t):
    return S.check_deltas(t.check_results(), _pairs(t, "before_id", "after_id"))


@query("snapshot_score_deltas", _q(f""", {_PAIRS} SELECT a AS before_id, b AS after_id, y.overall_score - x.overall_score AS overall_delta,
  CASE WHEN x.overall_score <> 0 THEN floor((y.overall_score - x.overall_score) * 100.0 / x.overall_score * 100 + 0.5) / 100 END AS overall_percent, y.readiness_level - x.readiness_level AS level_delta,
  y.current_readiness - x.current_readiness AS current_delta, y.future_readiness - x.future_readiness AS future_delta,
  CASE WHEN x.readability IS NOT NULL OR y.readability IS NOT NULL THEN coalesce(y.readability, 0) - coalesce(x.readability, 0) END AS readability_delta,
  CASE WHEN x.interactivity IS NOT NULL OR y.interactivity IS NOT NULL THEN coalesce(y.interactivity, 0) - coalesce(x.interactivity, 0) END AS interactivity_delta, NULL::INT AS transactional_delta,
  CASE WHEN y.overall_score > x.overall_score THEN 'improved' WHEN y.overall_score < x.overall_score THEN 'regressed' ELSE 'unchanged' END AS direction
FROM prs JOIN scored x ON x.scan_id = a JOIN scored y ON y.scan_id = b"""))
def snapshot_score_deltas(t):
    return S.score_deltas(_scores(t), _pairs(t, "before_id", "after_id"))


def _dir(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 'improved' WHEN {x} < 0 THEN 'regressed' ELSE 'unchanged' END"


@query("snapshot_comparison", sql(f"""
SELECT x.snapshot_id AS before_id, y.snapshot_id AS after_id, y.overall_score - x.overall_score AS overall_delta,
  CASE WHEN x.overall_score <> 0 THEN floor((y.overall_score - x.overall_score) * 100.0 / x.overall_score * 10 + 0.5) / 10 END AS overall_percent, {_dir('y.overall_score - x.overall_score')} AS overall_direction,
  y.readiness_level - x.readiness_level AS level_delta, {_dir('y.readiness_level - x.readiness_level')} AS level_direction,
  {', '.join(f"y.{c} - x.{c} AS {c}_delta, {_dir(f'y.{c} - x.{c}')} AS {c}_direction" for c in K.CATEGORIES)},
  y.citations - x.citations AS citation_delta, {_dir('y.citations - x.citations')} AS citation_direction
FROM score_snapshots x JOIN score_snapshots y ON y.snapshot_id = x.snapshot_id + 1""", "score_snapshots"))
def snapshot_comparison(t):
    s = t.score_snapshots()
    cols = {"id": "snapshot_id", "overall": "overall_score", "level": "readiness_level", "citations": "citations", **{c: c for c in K.CATEGORIES}}
    side = lambda n: s.select(*[C(v).alias(f"{n}_{k}") for k, v in cols.items()])
    pairs = side("before").withColumn("after_id", C("before_id") + 1).join(side("after"), "after_id")
    return S.snapshot_comparison(pairs)


@query("completed_scans_in_range", sql("""
SELECT scan_id FROM scans WHERE status IN ('completed', 'processing') AND domain = 'site7.example' AND scanned_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'""", "scans"))
def completed_scans(t):
    """Optional filters put together: membership, equality and a date range."""
    from datetime import datetime

    from sightline.operators.metrics import between

    rows = where(t.scans(), {"domain": "site7.example", "user_id": None}, {"status": ["completed", "processing"]})
    return between(rows, "scanned_at", datetime(1996, 1, 1), datetime(1999, 12, 31)).select("scan_id")


@query("json_field_filter", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IN ('7', '69')")
def json_field_filter(t):
    k = F.get_json_object("props", "$.k")
    return t.raw("events").filter(k.isin("7", "69")).select("event_id", k.cast("long").alias("k"))


@query("live_scans", sql("SELECT status, count(*) AS scans FROM scans WHERE NOT is_deleted GROUP BY 1", "scans"))
def live_scans(t):
    """Rows marked as deleted stay out."""
    return t.scans().filter(~C("is_deleted")).groupBy("status").agg(F.count(F.lit(1)).alias("scans"))


_ST = "['pending','in_progress','succeeded','failed','rolled_back']"


@query("illegal_transitions", f"""
WITH s AS (SELECT user_id AS deployment_id, event_id, ts, {_ST}[event_id % 5 + 1] AS status FROM events),
l AS (SELECT *, lag(status) OVER (PARTITION BY deployment_id ORDER BY ts, event_id) AS p FROM s)
SELECT deployment_id, event_id, p AS previous_status, status, p IN ('failed', 'rolled_back') AS from_terminal FROM l WHERE p IS NOT NULL AND p <> status
AND p || '>' || status NOT IN ('pending>in_progress','pending>failed','in_progress>succeeded','in_progress>failed','succeeded>rolled_back','succeeded>failed')""")
def illegal_transitions(t):
    states = F.array(*[F.lit(s) for s in ("pending", "in_progress", "succeeded", "failed", "rolled_back")])
    h = t.raw("events").select(
        C("user_id").alias("deployment_id"), "event_id", "ts", F.element_at(states, (C("event_id") % 5 + 1).cast("int")).alias("status"))
    out = S.illegal_transitions(h, K.DEPLOYMENT_TRANSITIONS, "deployment_id", ["ts", "event_id"])
    return out.select("deployment_id", "event_id", "previous_status", "status", "from_terminal")


@query("checks_by_category", _q("""
SELECT scan_id, category, string_agg(check_id || ':' || score, ',' ORDER BY check_id) AS checks, CASE category WHEN 'readability' THEN 1 ELSE 2 END::BIGINT AS category_rank
FROM check_results JOIN check_dim USING (check_id) GROUP BY 1, 2"""))
def checks_by_category(t):
    out = S.checks_by_category(t.check_results())
    return out.withColumn("checks", F.array_join(F.transform("checks", lambda c: F.concat_ws(":", c["check_id"], c["score"])), ","))


@query("common_checks", _q(f""", {_PAIRS} SELECT a, b, count(*) AS common FROM prs JOIN okc x ON x.scan_id = a JOIN okc y ON y.scan_id = b AND y.check_id = x.check_id GROUP BY 1, 2"""))
def common_checks(t):
    """Number of checks two scans share."""
    return S.compare_checks(t.check_results(), _pairs(t, "primary_id", "competitor_id")).groupBy(
        C("primary_id").alias("a"), C("competitor_id").alias("b")).agg(F.count(F.lit(1)).alias("common"))
