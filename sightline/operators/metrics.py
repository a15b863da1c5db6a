"""Aggregates over mentions, citations, scans and services.

Counts by condition are taken in one pass (``count_if``) and tops end in ``orderBy().limit()`` with a key as the
tie-break, which Spark runs as a distributed top-k.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import dates
from sightline.functions.numbers import round_half_up
from sightline.operators.skew import latest_per_key

C = F.col


def between(df: DataFrame, column: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    if start is not None:
        df = df.filter(C(column) >= F.lit(start))
    if end is not None:
        df = df.filter(C(column) <= F.lit(end))
    return df


def where(df: DataFrame, equals: dict | None = None, any_of: dict | None = None, locale: tuple | None = None) -> DataFrame:
    """Optional filters: equality (None means no filter), membership, and ``(column, value or None)`` where None
    selects rows without a value."""
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.filter(C(name) == value)
    for name, values in (any_of or {}).items():
        if values:
            df = df.filter(C(name).isin(*values))
    if locale is not None:
        name, value = locale
        df = df.filter(C(name).isNull() if value is None else C(name) == value)
    return df


def top(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(key)).limit(k)


def cost_by(costs: DataFrame, group: str) -> DataFrame:
    """Cost and number of answers by ``day`` or ``ai_engine``, dearest first."""
    key = dates.day(C("queried_at")).alias("day") if group == "day" else C(group)
    return costs.groupBy(key).agg(
        F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("cost_cents"), F.count(F.lit(1)).alias("queries")
    ).orderBy(F.desc("cost_cents"))


def attribution_counts(attributions: DataFrame, mentions: DataFrame, group: str) -> DataFrame:
    """Own, foreign, matched and unstructured sources of mentions, per column of the mentions."""
    return attributions.join(mentions.select("mention_id", group), "mention_id").groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(C("is_own_domain")).alias("own"),
        F.count_if(~C("is_own_domain")).alias("foreign_sources"),
        F.count_if(C("matched_page_id").isNotNull()).alias("matched"),
        F.count_if(C("source_type") == "unstructured").alias("unstructured"))


def sentiment_counts() -> list[Column]:
    return [F.count_if(C("sentiment") == s).alias(s) for s in ("positive", "neutral", "negative")]


def sentiment_series(mentions: DataFrame, keys: list[str], unit: str = "day") -> DataFrame:
    """Sentiment counts per day or week (weeks start on Monday, UTC)."""
    bucket = dates.day(F.date_trunc(unit, "mentioned_at")).alias("bucket")
    return mentions.groupBy(*keys, bucket).agg(*sentiment_counts(), F.count(F.lit(1)).alias("total"))


def previous_window(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The window of equal length that ends one millisecond before ``start``."""
    before = start - timedelta(milliseconds=1)
    return before - (end - start), before


def period(column: str, start: datetime, end: datetime) -> Column:
    """current, previous or null for a time."""
    p_start, p_end = previous_window(start, end)
    return F.when(C(column).between(F.lit(start), F.lit(end)), "current").when(
        C(column).between(F.lit(p_start), F.lit(p_end)), "previous")


def overview(mentions: DataFrame, rankings: DataFrame, snapshots: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Per project and period: mentions by sentiment, latest answer, average rank, top engine.

    Rows are tagged with their period and aggregated once, instead of a query per number and period.
    """
    keys = ["project_id", "period"]
    tag = lambda df, c: df.withColumn("period", period(c, start, end)).filter(C("period").isNotNull())
    m = tag(mentions, "mentioned_at")
    counts = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("mentions"), *sentiment_counts())
    ranks = tag(rankings, "ranked_at").groupBy(*keys).agg(F.avg("rank_position").alias("avg_rank"))
    latest = tag(snapshots, "queried_at").groupBy(*keys).agg(F.max("queried_at").alias("latest_snapshot"))
    engines = m.join(snapshots.select("snapshot_id", "ai_engine"), "snapshot_id", "left").groupBy(*keys, "ai_engine").agg(
        F.count(F.lit(1)).alias("n"))
    # most mentions first, then the name; an unknown engine counts as a group of its own
    best = engines.groupBy(*keys).agg(F.min_by("ai_engine", F.struct(-C("n"), F.coalesce("ai_engine", F.lit("")))).alias("top_engine"))
    out = counts.join(ranks, keys, "full_outer").join(latest, keys, "full_outer").join(best, keys, "left")
    zero = ["mentions", "positive", "neutral", "negative"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def citation_page_counts(graph: DataFrame, as_of: datetime, days: int, keys: list[str]) -> DataFrame:
    """Citations per key: all, in the current window and in the one before it."""
    now = F.lit(as_of)
    cut, prior = now - F.expr(f"INTERVAL {days} DAYS"), now - F.expr(f"INTERVAL {2 * days} DAYS")
    at = C("extracted_at")
    return graph.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(at >= cut).alias("current_period"),
        F.count_if((at >= prior) & (at < cut)).alias("prior_period"))


def citation_graph(citations: DataFrame, mappings: DataFrame, pages: DataFrame) -> DataFrame:
    """The shared join citation - mapping - cited page that the citation reports aggregate."""
    return mappings.select("citation_id", "cited_page_id", "match_type").join(citations, "citation_id").join(
        pages.select("cited_page_id", "url", "domain", "client_page_id"), "cited_page_id")


def model_breakdown(graph: DataFrame, keys: list[str]) -> DataFrame:
    """Citations per key as a map model -> count, with the number of distinct URLs.

    The map has one entry per model. URL sets can be large, so they stay rows (``cited_urls``).
    """
    counts = graph.groupBy(*keys, "model_name").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", "n")))).alias("models"))
    distinct_urls = cited_urls(graph, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("urls"))
    return maps.join(distinct_urls, keys)


def cited_urls(graph: DataFrame, keys: list[str]) -> DataFrame:
    return graph.select(*keys, "url").distinct()


def citation_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Change between two snapshots (keys, total, models): total, percent, and per model.

    Percent is 100 when there was nothing before and something after, 0 when both are empty.
    """
    empty = F.map_from_arrays(F.array(), F.array()).cast("map<string,bigint>")
    j = before.select(*keys, C("total").alias("_b"), C("models").alias("_bm")).join(
        after.select(*keys, C("total").alias("_a"), C("models").alias("_am")), keys, "full_outer")
    b, a = F.coalesce("_b", F.lit(0)), F.coalesce("_a", F.lit(0))
    models = F.map_zip_with(
        F.coalesce("_bm", empty), F.coalesce("_am", empty),
        lambda k, x, y: F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0)))
    return j.select(
        *keys, b.alias("before"), a.alias("after"), (a - b).alias("change"),
        F.when(b == 0, F.when(a > 0, 100).otherwise(0)).otherwise(round_half_up((a - b) * 100 / b)).alias("percent"),
        models.alias("model_changes"))


def gained_and_lost(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Members only in one of two row sets over ``keys``."""
    gained = after.select(*keys).distinct().join(before, keys, "left_anti").withColumn("change", F.lit("gained"))
    lost = before.select(*keys).distinct().join(after, keys, "left_anti").withColumn("change", F.lit("lost"))
    return gained.unionByName(lost)


def citation_impact(snapshots: DataFrame) -> DataFrame:
    """Latest ``before`` against latest ``after`` snapshot per page (client_page_id, snapshot_type, total, captured_at)."""
    last = latest_per_key(snapshots, ["client_page_id", "snapshot_type"], ["captured_at", "total"])
    value = lambda kind: F.coalesce(F.max(F.when(C("snapshot_type") == kind, C("total"))), F.lit(0))
    wide = last.groupBy("client_page_id").agg(value("before").alias("before"), value("after").alias("after"))
    b, a = C("before"), C("after")
    return wide.withColumns(
        {
            "change": a - b,
            "percent": F.when(b == 0, F.when(a > 0, 100).otherwise(0)).otherwise(round_half_up((a - b) * 100 / b)),
        }
    )


def portfolio(snapshots: DataFrame, milestones: DataFrame, since: datetime) -> DataFrame:
    """One row per project: latest score and level, change against the baseline, recent milestones.

    Baseline and latest come from one aggregate instead of a lookup per project; without a baseline the change is 0.
    """
    row = F.struct("overall_score", "readiness_level", F.coalesce("citations", F.lit(0)).alias("citations"))
    order = F.struct("created_at", "snapshot_id")
    ends = snapshots.groupBy("project_id").agg(
        F.max_by(row, order).alias("latest"),
        F.min_by(F.when(C("snapshot_type") == "baseline", row), F.when(C("snapshot_type") == "baseline", order)).alias("base"))
    recent = milestones.filter(C("triggered_at") >= F.lit(since)).groupBy("project_id").agg(F.count(F.lit(1)).alias("milestones"))
    delta = lambda c: F.coalesce(C(f"latest.{c}") - C(f"base.{c}"), F.lit(0))
    return ends.join(recent, "project_id", "left").select(
        "project_id", C("latest.overall_score").alias("current_score"), C("latest.readiness_level").alias("readiness_level"),
        delta("overall_score").alias("score_delta"), delta("citations").alias("citation_delta"),
        F.coalesce("milestones", F.lit(0)).alias("milestones"))


def portfolio_kpis(projects: DataFrame) -> DataFrame:
    return projects.agg(
        round_half_up(F.avg("score_delta"), 1).alias("avg_score_change"),
        round_half_up(F.avg("citation_delta"), 1).alias("avg_citation_growth"),
        F.sum("milestones").alias("total_milestones"), F.count_if(C("score_delta") < 0).alias("projects_with_decline"))


def portfolio_extremes(projects: DataFrame, k: int = 5) -> DataFrame:
    """Best and worst ``k`` by score change; with fewer than 2k projects they overlap."""
    best = projects.orderBy(F.desc("score_delta"), "project_id").limit(k).withColumn("side", F.lit("top"))
    worst = projects.orderBy("score_delta", "project_id").limit(k).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def service_metrics(metrics: DataFrame, key: str) -> DataFrame:
    """Webhook success and failure rate and API error rate; no traffic counts as healthy."""
    success = F.when(C("deliveries") == 0, 1.0).otherwise(C("delivered") / F.nullif("deliveries", F.lit(0)))
    return metrics.select(
        key, success.alias("webhook_success_rate"), (1 - success).alias("webhook_failure_rate"),
        F.when(C("requests") == 0, 0.0).otherwise(C("errors") / F.nullif("requests", F.lit(0))).alias("api_error_rate"),
        C("csv_queued").cast("double").alias("csv_queued"), C("auth_failures").cast("double").alias("auth_failures"))


def firing_rules(metrics: DataFrame, key: str, rules: tuple = K.SERVICE_RULES) -> DataFrame:
    """Service rules that fire, with value, threshold and severity."""
    rows = F.array(*[
        F.struct(
            F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), C(metric).alias("value"), F.lit(limit).alias("threshold"),
            ((C(metric) >= limit) if at_limit else (C(metric) > limit)).alias("fires"))
        for rule, metric, limit, severity, at_limit in rules
    ])
    return service_metrics(metrics, key).select(key, F.explode(rows).alias("r")).filter(C("r.fires")).select(
        key, "r.rule", "r.severity", "r.value", "r.threshold")


def rank_deltas(daily: DataFrame, reference_day: str, keys: list[str]) -> DataFrame:
    """Rank on a day and its change against 1, 7 and 30 days before (null without data).

    ``daily`` (keys, ai_engine, day, avg_rank). The four days are read in one pass and pivoted.
    """
    ref = F.to_date(F.lit(reference_day))
    at = lambda n: F.max(F.when(C("day") == F.date_sub(ref, n), C("avg_rank")))
    days = [F.date_sub(ref, n) for n in (0, 1, 7, 30)]
    wide = daily.filter(C("day").isin(*days)).groupBy(*keys, "ai_engine").agg(
        at(0).alias("current_rank"), at(1).alias("_1"), at(7).alias("_7"), at(30).alias("_30"))
    change = lambda n: (C("current_rank") - C(f"_{n}")).alias(f"delta_{n}d")
    return wide.select(*keys, "ai_engine", "current_rank", change(1), change(7), change(30))


def aggregate_rank_deltas(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over engines with equal weight, among engines with a current rank; one decimal."""
    names = ("current_rank", "delta_1d", "delta_7d", "delta_30d")
    return deltas.filter(C("current_rank").isNotNull()).groupBy(*keys).agg(
        *[round_half_up(F.avg(n), 1).alias(n) for n in names])
