"""Aggregated reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sightline import constants as K
from sightline.catalog import query
from sightline.catalog.citing import _PRICES
from sightline.catalog.views import sql
from sightline.functions import dates
from sightline.operators import metrics as M
from sightline.operators.citations import answer_cost

C = F.col
START, END = datetime(2024, 1, 15), datetime(2024, 1, 25)
_COST = f"""costs AS (SELECT snapshot_id, ai_engine, queried_at, coalesce(round((input_tokens * i + output_tokens * o)::DECIMAL(38, 2), 0)::DOUBLE / 10000, 0) AS cents
FROM answers LEFT JOIN (VALUES {_PRICES}) p(model, i, o) USING (model))"""


def _costs(t):
    return t.answers().select("ai_engine", "queried_at", answer_cost(C("model"), C("input_tokens"), C("output_tokens")).alias("cost_cents"))


def _double(df, *names):
    return df.withColumns({n: F.round(C(n).cast("double"), 4) for n in names})


@query("cost_by_day", sql(f"WITH {_COST} SELECT strftime(queried_at, '%Y-%m-%d') AS day, round(sum(cents), 4) AS cost_cents, count(*) AS queries FROM costs GROUP BY 1", "answers"))
def cost_by_day(t):
    return _double(M.cost_by(_costs(t), "day"), "cost_cents")


@query("cost_by_engine", sql(f"WITH {_COST} SELECT ai_engine, round(sum(cents), 4) AS cost_cents, count(*) AS queries FROM costs GROUP BY 1", "answers"))
def cost_by_engine(t):
    return _double(M.cost_by(_costs(t), "ai_engine"), "cost_cents")


@query("attribution_counts", sql("""
SELECT m.brand_name, count(*) AS total, count_if(is_own_domain) AS own, count_if(NOT is_own_domain) AS foreign_sources,
  count(matched_page_id) AS matched, count_if(source_type = 'unstructured') AS unstructured
FROM source_attributions s JOIN mentions m USING (mention_id) GROUP BY 1""", "source_attributions", "mentions"))
def attribution_counts(t):
    return M.attribution_counts(t.source_attributions(), t.mentions(), "brand_name")


_SENT = "count_if(sentiment = 'positive') AS positive, count_if(sentiment = 'neutral') AS neutral, count_if(sentiment = 'negative') AS negative"
for _unit in ("day", "week"):
    def _make(unit):
        return lambda t: M.sentiment_series(t.mentions(), ["project_id"], unit)
    query(f"sentiment_by_{_unit}", sql(
        f"SELECT project_id, strftime(date_trunc('{_unit}', mentioned_at), '%Y-%m-%d') AS bucket, {_SENT}, count(*) AS total FROM mentions GROUP BY 1, 2", "mentions"))(_make(_unit))


@query("visibility_overview", sql(f"""
WITH p AS (SELECT 'current' AS period, TIMESTAMP '2024-01-15' AS a, TIMESTAMP '2024-01-25' AS b UNION ALL SELECT 'previous', TIMESTAMP '2024-01-04 23:59:59.999', TIMESTAMP '2024-01-14 23:59:59.999'),
m AS (SELECT period, m.* FROM mentions m JOIN p ON mentioned_at BETWEEN a AND b),
c AS (SELECT project_id, period, count(*) AS mentions, {_SENT} FROM m GROUP BY 1, 2),
s AS (SELECT project_id, period, max(queried_at) AS latest FROM answers JOIN p ON queried_at BETWEEN a AND b GROUP BY 1, 2),
e AS (SELECT m.project_id, period, ai_engine, count(*) AS n FROM m LEFT JOIN answers USING (snapshot_id) GROUP BY 1, 2, 3),
b AS (SELECT project_id, period, ai_engine AS top_engine FROM (SELECT *, row_number() OVER (PARTITION BY project_id, period ORDER BY n DESC, coalesce(ai_engine, '')) AS rn FROM e) WHERE rn = 1),
r AS (SELECT project_id, period, round(avg(rank_position), 6) AS avg_rank FROM (SELECT *, TIMESTAMP '2024-01-02' + to_days(((ranked_at::DATE - DATE '1970-01-01') % 30)::INT) AS rk_at FROM rankings) JOIN p ON rk_at BETWEEN a AND b GROUP BY 1, 2)
SELECT project_id, period, coalesce(mentions, 0) AS mentions, coalesce(positive, 0) AS positive, coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative,
  strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest_snapshot, top_engine, avg_rank
FROM c FULL JOIN s USING (project_id, period) FULL JOIN r USING (project_id, period) LEFT JOIN b USING (project_id, period)""", "mentions", "answers", "rankings"))
def visibility_overview(t):
    # rankings of the orders' years, carried into the month of the mentions
    shifted = F.date_add(F.lit("2024-01-02").cast("date"), F.unix_date(F.to_date("ranked_at")) % 30).cast("timestamp")
    out = M.overview(t.mentions(), t.rankings().withColumn("ranked_at", shifted), t.answers(), START, END)
    return out.withColumns({"latest_snapshot": F.date_format("latest_snapshot", "yyyy-MM-dd HH:mm:ss"), "avg_rank": F.round("avg_rank", 6)})


@query("period_ranks", sql("""
SELECT project_id, CASE WHEN ranked_at BETWEEN TIMESTAMP '2000-06-01' AND TIMESTAMP '2000-12-01' THEN 'current' ELSE 'previous' END AS period, round(avg(rank_position), 6) AS avg_rank, count(*) AS n
FROM rankings WHERE ranked_at BETWEEN TIMESTAMP '1999-11-30 23:59:59.999' AND TIMESTAMP '2000-05-31 23:59:59.999' OR ranked_at BETWEEN TIMESTAMP '2000-06-01' AND TIMESTAMP '2000-12-01' GROUP BY 1, 2""", "rankings"))
def period_ranks(t):
    """Average rank of a period and of the equally long one before it, in one aggregate."""
    tagged = t.rankings().withColumn("period", M.period("ranked_at", datetime(2000, 6, 1), datetime(2000, 12, 1)))
    return tagged.filter(C("period").isNotNull()).groupBy("project_id", "period").agg(
        F.round(F.avg("rank_position"), 6).alias("avg_rank"), F.count(F.lit(1)).alias("n"))


@query("top_brands", sql("SELECT brand_name, count(*) AS mentions FROM mentions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "mentions"))
def top_brands(t):
    return M.top(t.mentions().groupBy("brand_name").agg(F.count(F.lit(1)).alias("mentions")), "mentions", "brand_name", 5)


def _graph(t):
    return M.citation_graph(t.citations(), t.mappings(), t.cited_pages())


_G = ("citations", "mappings", "cited_pages", "audits")
_AS_OF = "TIMESTAMP '2001-08-01'"


@query("citations_by_model", sql("SELECT user_id, model_name, count(*) AS citations FROM citations JOIN audits USING (audit_id) GROUP BY 1, 2", *_G))
def citations_by_model(t):
    return t.citations().join(t.audits(), "audit_id").groupBy("user_id", "model_name").agg(F.count(F.lit(1)).alias("citations"))


@query("top_cited_pages", sql(f"""
SELECT client_page_id, count(*) AS citations, count_if(extracted_at >= {_AS_OF} - INTERVAL 90 DAY) AS current_period,
  count_if(extracted_at >= {_AS_OF} - INTERVAL 180 DAY AND extracted_at < {_AS_OF} - INTERVAL 90 DAY) AS prior_period
FROM mappings JOIN citations USING (citation_id) JOIN cited_pages USING (cited_page_id) WHERE client_page_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", *_G))
def top_cited_pages(t):
    counts = M.citation_page_counts(_graph(t).filter(C("client_page_id").isNotNull()), datetime(2001, 8, 1), 90, ["client_page_id"])
    return M.top(counts, "citations", "client_page_id", 10)


@query("top_cited_domains", sql("""
SELECT domain, count(*) AS citations FROM mappings JOIN citations USING (citation_id) JOIN cited_pages USING (cited_page_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", *_G))
def top_cited_domains(t):
    return M.top(_graph(t).groupBy("domain").agg(F.count(F.lit(1)).alias("citations")), "citations", "domain", 10)


@query("citation_trend", sql(f"""
SELECT strftime(extracted_at, '%Y-%m-%d') AS day, count(*) AS citations FROM citations WHERE extracted_at >= {_AS_OF} - INTERVAL 90 DAY GROUP BY 1""", "citations"))
def citation_trend(t):
    recent = t.citations().filter(C("extracted_at") >= F.lit(datetime(2001, 8, 1)) - F.expr("INTERVAL 90 DAYS"))
    return recent.groupBy(dates.day(C("extracted_at")).alias("day")).agg(F.count(F.lit(1)).alias("citations"))


@query("weekly_page_citations", sql("""
SELECT client_page_id, strftime(date_trunc('week', extracted_at), '%Y-%m-%d') AS week, count(*) AS citations
FROM mappings JOIN citations USING (citation_id) JOIN cited_pages USING (cited_page_id) WHERE client_page_id IS NOT NULL GROUP BY 1, 2""", *_G))
def weekly_page_citations(t):
    g = _graph(t).filter(C("client_page_id").isNotNull())
    return g.groupBy("client_page_id", dates.day(F.date_trunc("week", "extracted_at")).alias("week")).agg(F.count(F.lit(1)).alias("citations"))


@query("distinct_citations", sql("""
SELECT query_text, model_name, count(DISTINCT citation_id) AS citations, strftime(max(extracted_at), '%Y-%m-%d') AS latest
FROM mappings JOIN citations USING (citation_id) GROUP BY 1, 2""", *_G))
def distinct_citations(t):
    return _graph(t).groupBy("query_text", "model_name").agg(
        F.count_distinct("citation_id").alias("citations"), dates.day(F.max("extracted_at")).alias("latest"))


@query("model_breakdown", sql("""
WITH g AS (SELECT * FROM mappings JOIN citations USING (citation_id) JOIN cited_pages USING (cited_page_id)),
c AS (SELECT audit_id, client_page_id, model_name, count(*) AS n FROM g WHERE client_page_id IS NOT NULL GROUP BY 1, 2, 3),
u AS (SELECT audit_id, client_page_id, count(DISTINCT url) AS urls FROM g WHERE client_page_id IS NOT NULL GROUP BY 1, 2)
SELECT audit_id, client_page_id, sum(n)::BIGINT AS total, string_agg(model_name || '=' || n, ',' ORDER BY model_name) AS models, any_value(urls) AS urls
FROM c JOIN u USING (audit_id, client_page_id) GROUP BY 1, 2""", *_G))
def model_breakdown(t):
    out = M.model_breakdown(_graph(t).filter(C("client_page_id").isNotNull()), ["audit_id", "client_page_id"])
    text = F.array_join(F.transform(F.map_entries("models"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("models", text)


def _halves(t):
    g = _graph(t).filter(C("client_page_id").isNotNull())
    cut = F.lit(datetime(1998, 6, 1))
    return g.filter(C("extracted_at") < cut), g.filter(C("extracted_at") >= cut)


_H = """g AS (SELECT *, extracted_at < TIMESTAMP '1998-06-01' AS early FROM mappings JOIN citations USING (citation_id) JOIN cited_pages USING (cited_page_id) WHERE client_page_id IS NOT NULL)"""


@query("citation_deltas", sql(f"""WITH {_H},
m AS (SELECT client_page_id, model_name, count_if(NOT early) - count_if(early) AS d FROM g GROUP BY 1, 2),
p AS (SELECT client_page_id, count_if(early) AS before, count_if(NOT early) AS after FROM g GROUP BY 1)
SELECT client_page_id, before, after, after - before AS change, CASE WHEN before = 0 THEN CASE WHEN after > 0 THEN 100 ELSE 0 END ELSE floor((after - before) * 100.0 / before + 0.5) END::BIGINT AS percent,
  (SELECT string_agg(model_name || '=' || d, ',' ORDER BY model_name) FROM m WHERE m.client_page_id = p.client_page_id) AS model_changes FROM p""", *_G))
def citation_deltas(t):
    before, after = (M.model_breakdown(h, ["client_page_id"]) for h in _halves(t))
    out = M.citation_delta(before, after, ["client_page_id"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("model_changes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("model_changes", text).withColumn("percent", C("percent").cast("long"))


@query("gained_and_lost_urls", sql(f"""WITH {_H},
p AS (SELECT audit_id, url, bool_or(early) AS b, bool_or(NOT early) AS a FROM g GROUP BY 1, 2)
SELECT audit_id, url, CASE WHEN a THEN 'gained' ELSE 'lost' END AS change FROM p WHERE a <> b""", *_G))
def gained_and_lost_urls(t):
    before, after = _halves(t)
    keys = ["audit_id", "url"]
    return M.gained_and_lost(M.cited_urls(before, ["audit_id"]), M.cited_urls(after, ["audit_id"]), keys)


@query("citation_impact", sql("""
WITH s AS (SELECT project_id AS client_page_id, CASE WHEN snapshot_type = 'baseline' THEN 'before' ELSE 'after' END AS k, citations AS total, created_at FROM score_snapshots),
l AS (SELECT client_page_id, k, total FROM (SELECT *, row_number() OVER (PARTITION BY client_page_id, k ORDER BY created_at DESC, total DESC) AS rn FROM s) WHERE rn = 1),
w AS (SELECT client_page_id, coalesce(max(total) FILTER (WHERE k = 'before'), 0) AS before, coalesce(max(total) FILTER (WHERE k = 'after'), 0) AS after FROM l GROUP BY 1)
SELECT *, after - before AS change, CASE WHEN before = 0 THEN CASE WHEN after > 0 THEN 100 ELSE 0 END ELSE floor((after - before) * 100.0 / before + 0.5) END::BIGINT AS percent FROM w""", "score_snapshots"))
def citation_impact(t):
    s = t.score_snapshots().select(
        C("project_id").alias("client_page_id"), F.when(C("snapshot_type") == "baseline", "before").otherwise("after").alias("snapshot_type"),
        C("citations").alias("total"), C("created_at").alias("captured_at"))
    return M.citation_impact(s).withColumn("percent", C("percent").cast("long"))


@query("locale_scores", sql("SELECT locale, round(avg(score), 6) AS avg_score, count(*) AS scans FROM scans WHERE status = 'completed' GROUP BY 1", "scans"))
def locale_scores(t):
    return M.where(t.scans(), {"status": "completed"}).groupBy("locale").agg(
        F.round(F.avg("score"), 6).alias("avg_score"), F.count(F.lit(1)).alias("scans"))


@query("reddit_stats", sql("""
SELECT brand_id, subreddit, count(*) AS mentions, count_if(sentiment = 'positive') AS positive, count_if(sentiment = 'neutral') AS neutral, count_if(sentiment = 'negative') AS negative
FROM brand_links l LEFT JOIN posts p ON p.reddit_id = l.mention_id GROUP BY 1, 2""", "brand_links", "posts"))
def reddit_stats(t):
    posts = t.posts().select(C("reddit_id").alias("mention_id"), "subreddit")
    return t.brand_links().join(posts, "mention_id", "left").groupBy("brand_id", "subreddit").agg(
        F.count(F.lit(1)).alias("mentions"), *M.sentiment_counts())


@query("event_counts", sql("""
SELECT 'dead_letters' AS measure, queue AS key, count(*) AS n FROM job_log WHERE state = 'failed' GROUP BY 2
UNION ALL SELECT 'events', event_type, count(*) FROM conversion_events GROUP BY 2
UNION ALL SELECT 'audits_in_window', 'all', count_if(event_type = 'view' AND created_at >= TIMESTAMP '2024-01-20') FROM conversion_events
UNION ALL SELECT 'confirmed_waitlist', 'all', count_if(event_type = 'signup' AND user_id % 3 = 0) FROM conversion_events""", "job_log", "conversion_events"))
def event_counts(t):
    e = t.conversion_events()
    dead = t.job_log().filter(C("state") == "failed").groupBy(C("queue").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    kinds = e.groupBy(C("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    totals = e.agg(
        F.count_if((C("event_type") == "view") & (C("created_at") >= F.lit(datetime(2024, 1, 20)))).alias("audits_in_window"),
        F.count_if((C("event_type") == "signup") & (C("user_id") % 3 == 0)).alias("confirmed_waitlist"),
    ).unpivot([], ["audits_in_window", "confirmed_waitlist"], "measure", "n").select("measure", F.lit("all").alias("key"), "n")
    named = lambda df, m: df.select(F.lit(m).alias("measure"), "key", "n")
    return named(dead, "dead_letters").unionByName(named(kinds, "events")).unionByName(totals)


_PORTFOLIO = """
ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM score_snapshots) WHERE rn = 1),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, snapshot_id) AS rn FROM score_snapshots WHERE snapshot_type = 'baseline') WHERE rn = 1),
ms AS (SELECT project_id, count(*) AS milestones FROM score_snapshots WHERE overall_score >= 90 AND created_at >= TIMESTAMP '2001-01-01' GROUP BY 1),
pf AS (SELECT ls.project_id, ls.overall_score AS current_score, ls.readiness_level, coalesce(ls.overall_score - bs.overall_score, 0) AS score_delta,
  coalesce(ls.citations - bs.citations, 0) AS citation_delta, coalesce(milestones, 0) AS milestones FROM ls LEFT JOIN bs USING (project_id) LEFT JOIN ms USING (project_id))"""


def _portfolio(t):
    s = t.score_snapshots()
    milestones = s.filter(C("overall_score") >= 90).select("project_id", C("created_at").alias("triggered_at"))
    return M.portfolio(s, milestones, datetime(2001, 1, 1))


@query("portfolio", sql(f"WITH {_PORTFOLIO.strip()} SELECT * FROM pf", "score_snapshots"))
def portfolio(t):
    return _portfolio(t)


@query("portfolio_kpis", sql(f"""WITH {_PORTFOLIO.strip()} SELECT floor(avg(score_delta) * 10 + 0.5) / 10 AS avg_score_change,
  floor(avg(citation_delta) * 10 + 0.5) / 10 AS avg_citation_growth, sum(milestones)::BIGINT AS total_milestones, count_if(score_delta < 0) AS projects_with_decline FROM pf""", "score_snapshots"))
def portfolio_kpis(t):
    return M.portfolio_kpis(_portfolio(t))


@query("portfolio_extremes", sql(f"""WITH {_PORTFOLIO.strip()} SELECT * FROM (SELECT project_id, score_delta, 'top' AS side FROM pf ORDER BY 2 DESC, 1 LIMIT 5)
UNION ALL SELECT * FROM (SELECT project_id, score_delta, 'bottom' FROM pf ORDER BY 2, 1 LIMIT 5)""", "score_snapshots"))
def portfolio_extremes(t):
    return M.portfolio_extremes(_portfolio(t)).select("project_id", "score_delta", "side")


@query("score_timeline", sql("SELECT strftime(created_at, '%Y-%m-%d') AS day, floor(avg(overall_score) + 0.5)::BIGINT AS avg_score FROM score_snapshots WHERE created_at >= TIMESTAMP '2001-01-01' GROUP BY 1", "score_snapshots"))
def score_timeline(t):
    recent = M.between(t.score_snapshots(), "created_at", datetime(2001, 1, 1))
    return recent.groupBy(dates.day(C("created_at")).alias("day")).agg(F.floor(F.avg("overall_score") + 0.5).alias("avg_score"))


_SERVICE = """sm AS (SELECT user_id % 20 AS service, count_if(event_type IN ('click', 'error')) AS deliveries, count_if(event_type = 'click') AS delivered,
  count_if(event_type <> 'signup') AS requests, count_if(event_type = 'error' AND value > 400) AS errors, count_if(event_type = 'view') AS csv_queued, count_if(event_type = 'signup' AND value > 485) AS auth_failures FROM events GROUP BY 1)"""


def _service(t):
    e, n = C("event_type"), F.count_if
    return t.raw("events").groupBy((C("user_id") % 20).alias("service")).agg(
        n(e.isin("click", "error")).alias("deliveries"), n(e == "click").alias("delivered"), n(e != "signup").alias("requests"),
        n((e == "error") & (C("value") > 400)).alias("errors"), n(e == "view").alias("csv_queued"), n((e == "signup") & (C("value") > 485)).alias("auth_failures"))


@query("service_rates", f"""WITH {_SERVICE} SELECT service, round(delivered / deliveries, 6) AS webhook_success_rate, round(1 - delivered / deliveries, 6) AS webhook_failure_rate, round(errors / requests, 6) AS api_error_rate FROM sm""")
def service_rates(t):
    return M.service_metrics(_service(t), "service").select(
        "service", *[F.round(c, 6).alias(c) for c in ("webhook_success_rate", "webhook_failure_rate", "api_error_rate")])


_RATES = {"webhook_failure_rate": "1 - delivered / deliveries", "api_error_rate": "errors / requests", "csv_queued": "csv_queued", "auth_failures": "auth_failures"}
_FIRING = " UNION ALL ".join(
    f"SELECT service, '{rule}' AS rule, '{severity}' AS severity, round(({_RATES[metric]})::DOUBLE, 6) AS value, {limit}::DOUBLE AS threshold FROM sm WHERE {_RATES[metric]} {'>=' if at_limit else '>'} {limit}"
    for rule, metric, limit, severity, at_limit in K.SERVICE_RULES)


@query("service_alerts", f"WITH {_SERVICE} {_FIRING}")
def service_alerts(t):
    return M.firing_rules(_service(t), "service").withColumn("value", F.round("value", 6))


_DAILY = "daily AS (SELECT project_id, ai_engine, ranked_at::DATE AS day, avg(rank_position) AS avg_rank FROM rankings GROUP BY 1, 2, 3)"


def _daily(t):
    return t.rankings().groupBy("project_id", "ai_engine", F.to_date("ranked_at").alias("day")).agg(F.avg("rank_position").alias("avg_rank"))


_DELTAS = _DAILY + """, deltas AS (SELECT c.project_id, c.ai_engine, c.avg_rank AS current_rank, c.avg_rank - a.avg_rank AS delta_1d, c.avg_rank - b.avg_rank AS delta_7d, c.avg_rank - d.avg_rank AS delta_30d
FROM (SELECT * FROM daily WHERE day = DATE '2000-03-31') c LEFT JOIN daily a ON a.project_id = c.project_id AND a.ai_engine = c.ai_engine AND a.day = DATE '2000-03-30'
LEFT JOIN daily b ON b.project_id = c.project_id AND b.ai_engine = c.ai_engine AND b.day = DATE '2000-03-24' LEFT JOIN daily d ON d.project_id = c.project_id AND d.ai_engine = c.ai_engine AND d.day = DATE '2000-03-01')"""
_RD = ("current_rank", "delta_1d", "delta_7d", "delta_30d")


@query("rank_deltas", sql(f"WITH {_DELTAS} SELECT project_id, ai_engine, {', '.join(f'round({c}, 6) AS {c}' for c in _RD)} FROM deltas", "rankings"))
def rank_deltas(t):
    out = M.rank_deltas(_daily(t), "2000-03-31", ["project_id"]).filter(C("current_rank").isNotNull())
    return out.withColumns({c: F.round(c, 6) for c in _RD})


@query("rank_deltas_all_engines", sql(f"WITH {_DELTAS} SELECT project_id, {', '.join(f'floor(avg({c}) * 10 + 0.5) / 10 AS {c}' for c in _RD)} FROM deltas GROUP BY 1", "rankings"))
def rank_deltas_all(t):
    return M.aggregate_rank_deltas(M.rank_deltas(_daily(t), "2000-03-31", ["project_id"]), ["project_id"])
