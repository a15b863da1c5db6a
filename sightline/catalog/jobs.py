"""Periodic and streaming jobs."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from sightline.catalog import ORACLE, query
from sightline.catalog.mining import _strategy_sql, config
from sightline.catalog.views import sql
from sightline.operators import jobs as J
from sightline.operators.metrics import period
from sightline.session import checkpoint_dir
from sightline.streaming import jobs as S

C = F.col
H = 3600


def _failures(t):
    return t.job_log().filter(C("state") == "failed").select("queue", "job_id", "ts")


_FAIL = """
f AS (SELECT queue, job_id, ts, epoch_us(ts) AS at_us FROM job_log WHERE state = 'failed'),
c AS (SELECT *, count(*) OVER (PARTITION BY queue ORDER BY at_us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS failures FROM f),
hot AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY at_us, job_id) AS rn FROM c WHERE failures >= 5),
fired AS (SELECT queue, rn, job_id, failures, at_us FROM hot WHERE rn = 1
  UNION ALL SELECT n.queue, n.rn, n.job_id, n.failures, n.at_us FROM fired p, LATERAL (SELECT * FROM hot h WHERE h.queue = p.queue AND h.at_us >= p.at_us + 43200000000 ORDER BY rn LIMIT 1) n)
"""


@query("failure_window_counts", sql(f"WITH {_FAIL.strip().rsplit('hot AS', 1)[0].rstrip().rstrip(',')} SELECT queue, job_id, failures FROM c", "job_log"))
def failure_window_counts(t):
    return J.failures_in_window(_failures(t), "queue", 6 * H).select("queue", "job_id", "failures")


@query("failure_alerts", sql(f"WITH RECURSIVE {_FAIL.strip()} SELECT queue, job_id, failures FROM fired", "job_log"))
def failure_alerts(t):
    return J.failure_alerts(_failures(t), 5, 6 * H, 12 * H).select("queue", "job_id", "failures")


@query("backlog_alerts", """
WITH RECURSIVE hot AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY at_us) AS rn FROM (SELECT 'queue' || user_id % 5 AS queue, epoch_us(ts) AS at_us, floor(value)::BIGINT AS waiting FROM events) WHERE waiting > 100),
fired AS (SELECT queue, rn, at_us, waiting FROM hot WHERE rn = 1
  UNION ALL SELECT n.queue, n.rn, n.at_us, n.waiting FROM fired p, LATERAL (SELECT * FROM hot h WHERE h.queue = p.queue AND h.at_us >= p.at_us + 21600000000 ORDER BY rn LIMIT 1) n)
SELECT queue, at_us, waiting FROM fired""")
def backlog_alerts(t):
    gauges = t.raw("events").select(F.concat(F.lit("queue"), C("user_id") % 5).alias("queue"), "ts", F.floor("value").alias("waiting"))
    return J.backlog_alerts(gauges, 100, 6 * H)


_BACKLOG_SQL = ORACLE["backlog_alerts"]


@query("stream_backlog_alerts", _BACKLOG_SQL)
def stream_backlog_alerts(t):
    """The same on a stream of gauge readings, shuffled in time."""
    gauges = t.raw("events").select(F.concat(F.lit("queue"), C("user_id") % 5).alias("queue"), C("ts").cast("timestamp").alias("ts"), F.floor("value").alias("waiting"))
    return _run(t, S.backlog_alerts(_shuffled(t, gauges), 100, 6 * H, "60 days"))


@query("alert_outcomes", sql("""
WITH m AS (SELECT project_id, count_if(mentioned_at BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25') AS cur, count_if(mentioned_at BETWEEN TIMESTAMP '2024-01-14 23:59:59.999' AND TIMESTAMP '2024-01-19 23:59:59.999') AS prev,
  count_if(mention_type = 'citation' AND mentioned_at >= TIMESTAMP '2024-01-24 12:00:00') AS cites FROM mentions GROUP BY 1),
r AS (SELECT s_suppkey AS rule_id, s_suppkey % 10 AS project_id, ['visibility_drop','new_citation','competitor_gain','other'][s_suppkey % 4 + 1] AS type, CASE WHEN s_suppkey % 3 = 0 THEN 5.0 END AS threshold,
  CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-24 20:00:00' WHEN s_suppkey % 5 = 1 THEN TIMESTAMP '2024-01-24 10:00:00' END AS last FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT rule_id, outcome, CASE WHEN outcome = 'fired' THEN CASE type WHEN 'visibility_drop' THEN -floor((prev - cur) * 100.0 / prev + 0.5) WHEN 'new_citation' THEN cites ELSE project_id - 4.0 END END::DOUBLE AS value FROM (
SELECT *, CASE WHEN date_diff('second', last, TIMESTAMP '2024-01-25') < 21600 THEN 'cooled_down'
  WHEN CASE type WHEN 'visibility_drop' THEN prev > 0 AND (prev - cur) * 100.0 / prev >= coalesce(threshold, 20) WHEN 'new_citation' THEN cites > 0 WHEN 'competitor_gain' THEN project_id - 4.0 >= coalesce(threshold, 3) ELSE false END THEN 'fired' ELSE 'quiet' END AS outcome
FROM r JOIN m USING (project_id))""", "mentions"))
def alert_outcomes(t):
    p = period("mentioned_at", datetime(2024, 1, 20), datetime(2024, 1, 25))
    metrics = t.mentions().groupBy("project_id").agg(
        F.count_if(p == "current").alias("current_mentions"), F.count_if(p == "previous").alias("previous_mentions"),
        F.count_if((C("mention_type") == "citation") & (C("mentioned_at") >= F.lit(datetime(2024, 1, 24, 12)))).alias("new_citations"),
    ).withColumns({"current_rank": C("project_id").cast("double"), "previous_rank": F.lit(4.0)})
    k = C("s_suppkey")
    kinds = F.array(*[F.lit(x) for x in ("visibility_drop", "new_citation", "competitor_gain", "other")])
    rules = t.raw("supplier").select(
        k.alias("rule_id"), (k % 10).alias("project_id"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("type"), F.when(k % 3 == 0, 5.0).alias("threshold"),
        F.lit(None).cast("int").alias("cooldown_minutes"),
        F.when(k % 5 == 0, F.lit(datetime(2024, 1, 24, 20))).when(k % 5 == 1, F.lit(datetime(2024, 1, 24, 10))).alias("last_fired_at"), (k % 7 != 0).alias("enabled"))
    return J.evaluate_alerts(rules, metrics, datetime(2024, 1, 25)).select("rule_id", "outcome", "value")


@query("stream_rule_alerts", """
WITH RECURSIVE o AS (SELECT user_id % 10 AS project_id, ts, event_type <> 'error' AS is_mention, event_type = 'signup' AS is_citation, CASE WHEN event_type = 'view' THEN event_id % 9 + 1 END AS rank FROM events),
c AS (SELECT project_id, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS e, count_if(is_mention) AS mentions, count_if(is_citation) AS cites, avg(rank) AS rank FROM o GROUP BY 1, 2),
m AS (SELECT coalesce(c.project_id, p.project_id) AS project_id, coalesce(c.e, p.e + INTERVAL 6 HOUR) AS e, coalesce(c.mentions, 0) AS cur, coalesce(p.mentions, 0) AS prev, coalesce(c.cites, 0) AS cites, c.rank - p.rank AS loss
  FROM c FULL JOIN c p ON p.project_id = c.project_id AND p.e + INTERVAL 6 HOUR = c.e),
r AS (SELECT s_suppkey AS rule_id, s_suppkey % 10 AS project_id, ['visibility_drop','new_citation','competitor_gain','other'][s_suppkey // 10 % 4 + 1] AS type, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 END AS threshold,
  CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 * 500 ELSE 360 END AS minutes, CASE WHEN s_suppkey % 5 = 1 THEN TIMESTAMP '2024-01-02' END AS given FROM supplier WHERE s_suppkey % 7 <> 0),
t AS (SELECT rule_id, project_id, type, e, minutes, given, row_number() OVER (PARTITION BY rule_id ORDER BY e) AS rn,
  CASE type WHEN 'visibility_drop' THEN prev > 0 AND (prev - cur) * 100.0 / prev >= coalesce(threshold, 20) WHEN 'new_citation' THEN cites > 0 WHEN 'competitor_gain' THEN coalesce(loss >= coalesce(threshold, 3), false) ELSE false END AS fires,
  CASE type WHEN 'visibility_drop' THEN -floor((prev - cur) * 100.0 / prev + 0.5) WHEN 'new_citation' THEN cites ELSE loss END::DOUBLE AS value FROM m JOIN r USING (project_id)),
walk AS (SELECT t.*, given AS last, coalesce(e - given < to_minutes(minutes), false) AS cooling FROM t WHERE rn = 1
  UNION ALL SELECT n.*, CASE WHEN w.fires AND NOT w.cooling THEN w.e ELSE w.last END, coalesce(n.e - CASE WHEN w.fires AND NOT w.cooling THEN w.e ELSE w.last END < to_minutes(n.minutes), false)
  FROM walk w JOIN t n ON n.rule_id = w.rule_id AND n.rn = w.rn + 1)
SELECT rule_id, project_id, type, strftime(e, '%Y-%m-%d %H') AS period_end, CASE WHEN cooling THEN 'cooled_down' WHEN fires THEN 'fired' ELSE 'quiet' END AS outcome, CASE WHEN fires AND NOT cooling THEN round(value, 6) END AS value FROM walk""")
def stream_rule_alerts(t):
    """Alert rules on periods of six hours, as their events arrive in files of no order."""
    kind, k = C("event_type"), C("s_suppkey")
    rows = t.raw("events").select(
        (C("user_id") % 10).alias("project_id"), C("ts").cast("timestamp").alias("ts"), (kind != "error").alias("is_mention"), (kind == "signup").alias("is_citation"),
        F.when(kind == "view", C("event_id") % 9 + 1).cast("double").alias("rank"))
    kinds = F.array(*[F.lit(x) for x in ("visibility_drop", "new_citation", "competitor_gain", "other")])
    rules = t.raw("supplier").select(
        k.alias("rule_id"), (k % 10).alias("project_id"), F.get(kinds, F.floor(k / 10) % 4).alias("type"), F.when(k % 3 == 0, 1.0).alias("threshold"),
        F.when(k % 2 == 0, k % 5 * 500).cast("int").alias("cooldown_minutes"), F.when(k % 5 == 1, F.lit(datetime(2024, 1, 2))).alias("last_fired_at"), (k % 7 != 0).alias("enabled"))
    out = _run(t, S.rule_alerts(_shuffled(t, rows), rules, "6 hours", "60 days"))
    return out.select("rule_id", "project_id", "type", F.date_format("period_end", "yyyy-MM-dd HH").alias("period_end"), "outcome", F.round("value", 6).alias("value"))


@query("request_window_counts", """
SELECT client, strftime(time_bucket(INTERVAL 2 HOUR, ts), '%Y-%m-%d %H') AS hour, count(*) AS requests, least(count(*), 3) AS accepted, greatest(count(*) - 3, 0) AS refused
FROM (SELECT 'client' || user_id AS client, ts FROM events) GROUP BY 1, 2""")
def request_window_counts(t):
    requests = t.raw("events").select(F.concat(F.lit("client"), C("user_id")).alias("client"), "ts", F.lit(3).alias("max_requests"))
    return J.window_counts(requests, "2 hours").select("client", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "requests", "accepted", "refused")


@query("rate_limits", "SELECT event_id, CASE WHEN event_type = 'click' THEN CASE user_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 60 ELSE 5 END ELSE CASE user_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 300 ELSE 60 END END AS max_requests FROM events")
def rate_limits(t):
    group = F.when(C("event_type") == "click", "scan").otherwise("status")
    plan = F.when(C("user_id") % 3 == 0, "free").when(C("user_id") % 3 == 1, "pro")
    return t.raw("events").select("event_id", J.limit_of(group, plan).alias("max_requests"))


def _schedules(t):
    k = C("o_orderkey")
    f = F.element_at(F.array(*[F.lit(x) for x in ("hourly", "daily", "weekly", "odd")]), (k % 4 + 1).cast("int"))
    return t.raw("orders").select(
        k.alias("schedule_id"), (C("o_custkey") % 700).alias("project_id"), f.alias("frequency"), C("o_orderdate").alias("next_run_at"), (k % 5 == 0).alias("enabled"))


@query("due_schedules", """
SELECT o_orderkey AS schedule_id, 'ai-vis_sched_' || o_custkey % 700 || '_' || epoch_ms(o_orderdate) AS task_key,
  strftime(TIMESTAMP '1998-01-01 06:00:00' + to_hours(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 2 THEN 168 ELSE 24 END), '%Y-%m-%d %H:%M:%S') AS next_run FROM orders WHERE o_orderkey % 5 = 0 AND o_orderdate <= TIMESTAMP '1998-01-01 06:00:00'""")
def due_schedules(t):
    return J.due_schedules(_schedules(t), datetime(1998, 1, 1, 6)).select(
        "schedule_id", "task_key", F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("daily_sweep", """
SELECT project_id, 'Was ist ' || min(c_name) || '?' AS query_text, 'ai-vis:' || project_id || ':2024-01-20' AS task_key FROM (SELECT c_custkey % 800 AS project_id, c_name FROM customer)
WHERE project_id NOT IN (SELECT o_custkey % 700 FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1""")
def daily_sweep(t):
    projects = t.raw("customer").select((C("c_custkey") % 800).alias("project_id"), C("c_name").alias("keyword"))
    return J.daily_sweep(projects, _schedules(t), "2024-01-20")


@query("stale_jobs", sql("""
SELECT job_key, state FROM (SELECT job_id // 10 AS job_key, state, ts, row_number() OVER (PARTITION BY job_id // 10 ORDER BY ts DESC, state DESC) AS rn FROM job_log)
WHERE rn = 1 AND state IN ('waiting', 'active') AND ts < TIMESTAMP '2024-01-30 23:30:00'""", "job_log"))
def stale_jobs(t):
    jobs = t.job_log().select(F.floor(C("job_id") / 10).alias("job_key"), "state", "ts")
    return J.stale_jobs(jobs, datetime(2024, 1, 31)).select("job_key", "state")


@query("retained_rows", sql("""
SELECT 'dead_letters' AS kind, count(*) AS n FROM job_log WHERE state = 'failed' AND ts >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY
UNION ALL SELECT 'score_history', count(*) FROM score_snapshots WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 364 DAY
UNION ALL SELECT 'scans', count(*) FROM scans WHERE scanned_at >= TIMESTAMP '2001-08-01' - to_days(CASE WHEN user_id % 2 = 0 THEN 30 ELSE 365 END)""", "job_log", "score_snapshots", "scans"))
def retained_rows(t):
    from sightline import constants as K

    kept = {
        "dead_letters": J.retained(_failures(t), "ts", K.DEAD_LETTER_DAYS, datetime(2024, 2, 20)),
        "score_history": J.retained(t.score_snapshots(), "created_at", K.SCORE_HISTORY_DAYS, datetime(2001, 8, 1)),
        "scans": J.retained(t.scans(), "scanned_at", J.retention_days(F.when(C("user_id") % 2 == 0, "free").otherwise("agency")), datetime(2001, 8, 1)),
    }
    out = None
    for kind, df in kept.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("purged_html", "SELECT page_id, page_id % 10 < 4 AS kept FROM pages")
def purged_html(t):
    """Bodies older than 72 hours are emptied; the reading times are spread over ten days here."""
    pages = t.raw("pages").withColumn("fetched_at", F.date_sub(F.lit("2024-01-20").cast("date"), (C("page_id") % 10).cast("int")))
    return J.purge_html(pages, "fetched_at", datetime(2024, 1, 20)).select("page_id", C("html").isNotNull().alias("kept"))


@query("delivery_outcomes", sql("""
SELECT delivery_id, count(*) AS attempts, arg_max(http_status, (attempted_at, attempt_id)) AS last_status,
  CASE WHEN bool_or(http_status BETWEEN 200 AND 299) THEN 'delivered' WHEN count(*) >= 5 THEN 'dead_letter' ELSE 'failed' END AS status FROM deliveries GROUP BY 1""", "deliveries"))
def delivery_outcomes(t):
    return J.delivery_outcomes(t.deliveries())


@query("locale_fan_out", sql("""
SELECT scan_id, l.locale, CASE WHEN l.locale = 'de-DE' THEN 1 ELSE 10 END AS priority FROM scans JOIN (SELECT DISTINCT domain, locale FROM scans) l USING (domain)""", "scans"))
def locale_fan_out(t):
    locales = t.scans().select("domain", "locale").distinct().withColumn("is_primary", C("locale") == "de-DE")
    return J.locale_fan_out(t.scans().select("scan_id", "domain"), locales)


@query("queue_metrics", sql("""
SELECT q.queue, coalesce(count_if(state = 'waiting'), 0) AS waiting, coalesce(count_if(state = 'active'), 0) AS active, coalesce(count_if(state = 'completed'), 0) AS completed, coalesce(count_if(state = 'failed'), 0) AS failed,
  coalesce(count_if(state = 'delayed'), 0) AS delayed, 0 AS paused, max(j.queue) IS NULL AS error FROM (SELECT DISTINCT 'queue' || user_id % 7 AS queue FROM events) q LEFT JOIN job_log j USING (queue) GROUP BY 1""", "job_log"))
def queue_metrics(t):
    queues = t.raw("events").select(F.concat(F.lit("queue"), C("user_id") % 7).alias("queue")).distinct()
    return J.queue_metrics(t.job_log(), queues)


@query("service_health", sql("SELECT count_if(state = 'waiting') AS waiting, count_if(state = 'failed') AS failed, false AS partial, 'degraded' AS status FROM job_log", "job_log"))
def service_health(t):
    return J.service_health(J.queue_metrics(t.job_log(), t.job_log().select("queue").distinct()))


@query("send_list", """
WITH m AS (SELECT event_id AS message_id, user_id, ['transactional','report','alert'][event_id % 3 + 1] AS category, CASE WHEN event_id % 4 <> 0 THEN 'k' || event_id // 3 END AS ik FROM events)
SELECT message_id, CASE WHEN ik IN (SELECT 'k' || o_orderkey FROM orders WHERE o_orderkey % 10 = 0) OR min(message_id) OVER (PARTITION BY ik) < message_id AND ik IS NOT NULL THEN 'deduplicated'
  WHEN category <> 'transactional' AND user_id % 5 = 0 AND category = 'report' THEN 'suppressed' ELSE 'queued' END AS status FROM m""")
def send_list(t):
    k = C("event_id")
    messages = t.raw("events").select(
        k.alias("message_id"), "user_id", F.element_at(F.array(*[F.lit(x) for x in ("transactional", "report", "alert")]), (k % 3 + 1).cast("int")).alias("category"),
        F.when(k % 4 != 0, F.concat(F.lit("k"), F.floor(k / 3))).alias("idempotency_key"))
    sent = t.raw("orders").filter(C("o_orderkey") % 10 == 0).select(F.concat(F.lit("k"), "o_orderkey").alias("idempotency_key"))
    prefs = t.raw("events").select("user_id", F.explode(F.array(F.lit("report"), F.lit("alert"), F.lit("transactional"))).alias("category")).distinct().withColumn(
        "enabled", ~((C("user_id") % 5 == 0) & C("category").isin("report", "transactional")))
    return J.send_list(messages, sent, prefs)


# --- streams -------------------------------------------------------------------------------------------


def _stream(t, table):
    """The test table as a file stream. As a pattern, the path may be a file or a folder of files."""
    return t.spark.readStream.schema(t.raw(table).schema).option("maxFilesPerTrigger", 64).parquet(f"{t.path}/{table}.[p]arquet")


def _run(t, stream):
    base = f"{checkpoint_dir(t.spark)}/stream-{uuid4().hex}"
    S.write_available(stream, f"{base}/out", f"{base}/state")
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def _shuffled(t, rows, parts=3):
    """Rows (queue, ..., ts) as a stream of files in no order of time, and at the end a clock reading after the lateness allowed."""
    path = f"{checkpoint_dir(t.spark)}/shuffled-{uuid4().hex}"
    rows.repartition(parts, F.xxhash64(*rows.columns)).write.parquet(path)
    clock = rows.agg(F.max("ts").alias("ts")).select((C("ts") + F.expr("INTERVAL 70 DAYS")).alias("ts"))
    clock = clock.select(*[C("ts") if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    clock.coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _failure_stream(t):
    return _stream(t, "events").filter(C("event_type") == "error").select(
        F.concat(F.lit("queue"), C("user_id") % 5).alias("queue"), C("event_id").alias("job_id"), C("ts").cast("timestamp").alias("ts"))


@query("stream_failure_alerts", sql(f"WITH RECURSIVE {_FAIL.strip()} SELECT queue, job_id, failures FROM fired", "job_log"))
def stream_failure_alerts(t):
    """Failure alerts with managed state over micro-batches that are shuffled in time; equal to the batch result."""
    failures = _failures(t).withColumn("ts", C("ts").cast("timestamp"))
    return _run(t, S.failure_alerts(_shuffled(t, failures), 5, 6 * H, 12 * H, "60 days")).select("queue", "job_id", "failures")


@query("stream_failure_counts", sql("""
SELECT queue, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS failures FROM job_log WHERE state = 'failed' GROUP BY 1, 2""", "job_log"))
def stream_failure_counts(t):
    """All windows, those that are still open as well."""
    base = f"{checkpoint_dir(t.spark)}/stream-{uuid4().hex}"
    S.write_updates(S.failure_counts(_failure_stream(t), "1 day", "1 day"), f"{base}/out", f"{base}/state")
    out = S.latest_updates(t.spark, f"{base}/out", ["queue", "window_start"])
    return out.select("queue", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "failures")


@query("stream_deduplicated_jobs", sql("SELECT DISTINCT queue, job_id // 40 AS job_group FROM job_log", "job_log"))
def stream_deduplicated_jobs(t):
    """First job per (queue, group); repeats are suppressed."""
    jobs = _stream(t, "events").select(
        F.concat(F.lit("queue"), C("user_id") % 5).alias("queue"), F.floor(C("event_id") / 40).alias("job_group"), C("ts").cast("timestamp").alias("ts"))
    return _run(t, S.drop_repeats(jobs, ["queue", "job_group"], "40 days")).select("queue", "job_group")


@query("stream_mined_mentions", _strategy_sql("SELECT snapshot_id, position, matched_text, round(confidence, 6) AS confidence FROM kept"))
def stream_mined_mentions(t):
    """New answers mined as they arrive, facts written per micro-batch; equal to the batch result."""
    base = f"{checkpoint_dir(t.spark)}/mine-{uuid4().hex}"
    S.mine_stream(_stream(t, "conversations"), config(t), f"{base}/facts", f"{base}/state", prepare=t.answers)
    return S.read_facts(t.spark, f"{base}/facts", "mentions").select(
        "snapshot_id", "position", "matched_text", F.round("confidence", 6).alias("confidence"))
