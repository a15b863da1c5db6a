"""Time series per project or site: trends, milestones, score changes, snapshot types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import dates
from sightline.functions.numbers import round_half_up
from sightline.operators.skew import latest_per_key, previous_row, previous_values, top_k_per_key

C = F.col


def ranking_trend(rankings: DataFrame) -> DataFrame:
    """Latest rank per project, entity, engine and day; a competitor ranking counts under the competitor."""
    rows = rankings.select(
        "project_id", F.coalesce("competitor_name", "brand_name").alias("entity"), "ai_engine",
        dates.day(C("ranked_at")).alias("day"), "ranked_at", "ranking_id", "rank_position")
    keys = ["project_id", "entity", "ai_engine", "day"]
    return latest_per_key(rows, keys, ["ranked_at", "ranking_id", "rank_position"]).select(*keys, "rank_position")


def first_and_latest(snapshots: DataFrame) -> DataFrame:
    """First, latest and first baseline score per project, in one aggregate."""
    order = F.struct("created_at", "snapshot_id")
    base = C("snapshot_type") == "baseline"
    return snapshots.groupBy("project_id").agg(
        F.min_by("overall_score", order).alias("first_score"), F.max_by("overall_score", order).alias("latest_score"),
        F.min_by(F.when(base, C("overall_score")), F.when(base, order)).alias("baseline_score"))


def trend_label(first: Column, last: Column, points: Column, band: float = K.TREND_BAND) -> Column:
    """improving / declining / stable, by the relative change from first to last."""
    change = (last - first) / F.abs(F.nullif(first, F.lit(0)))
    return (
        F.when(points < 2, "stable")
        .when(first == 0, F.when(last > 0, "improving").when(last < 0, "declining").otherwise("stable"))
        .when(change > band, "improving").when(change < -band, "declining").otherwise("stable")
    )


def score_trends(history: DataFrame, key: str, order: list[str], score: str, bucket: Column | None = None) -> DataFrame:
    """Trend of every score against the first of the (up to) four latest scores at its time.

    The three scores before come from a bucketed look-back, so a long history is not sorted in one task.
    """
    df = previous_values(history, [key], order, score, 3, "_before", bucket)
    first = F.coalesce(F.try_element_at(C("_before"), F.lit(-1)), C(score))
    return df.withColumn("trend", trend_label(first, C(score), 1 + F.size("_before"))).drop("_before")


def latest_trends(history: DataFrame, key: str, order: list[Column], score: str) -> DataFrame:
    """Trend per key from its four latest scores only. At most four rows per key and partition are shuffled."""
    last = top_k_per_key(history, [key], order, 4)
    return last.groupBy(key).agg(
        F.max_by(score, "rank").alias("first"), F.min_by(score, "rank").alias("latest_score"), F.count(F.lit(1)).alias("points")
    ).select(key, "latest_score", trend_label(C("first"), C("latest_score"), C("points")).alias("trend"))


def score_changes(snapshots: DataFrame, key: str = "project_id") -> DataFrame:
    """Events for changed scores: previous, current, delta and level."""
    rows = previous_row(snapshots, [key], ["created_at", "snapshot_id"], ["overall_score"])
    delta = C("overall_score") - C("previous_overall_score")
    return rows.filter(delta != 0).select(
        key, "snapshot_id", "created_at", C("previous_overall_score").alias("previous"), C("overall_score").alias("current"),
        delta.alias("delta"), "readiness_level")


def detect_milestones(snapshots: DataFrame, platforms: DataFrame, existing: DataFrame) -> DataFrame:
    """Milestones of every snapshot, those already recorded left out.

    ``snapshots`` (project_id, snapshot_id, created_at, overall_score, citations, snapshot_type), ``platforms``
    (project_id, platform, seen_at), ``existing`` (project_id, milestone_type, milestone_key). A milestone is
    recorded once per project and key, at its first occurrence.

    Score thresholds compare with the snapshot before; citations and the improvement rate with the baseline, the
    rate within twice the window of days.
    """
    order = F.struct("created_at", "snapshot_id")
    is_base = C("snapshot_type") == "baseline"
    base = snapshots.filter(is_base).groupBy("project_id").agg(
        F.min_by(F.struct("overall_score", "citations", "created_at"), order).alias("base"))
    rows = previous_row(snapshots, ["project_id"], ["created_at", "snapshot_id"], ["overall_score"]).join(base, "project_id", "left")
    now, before = C("overall_score"), F.coalesce("previous_overall_score", F.lit(0))
    cites, base_cites = C("citations"), F.coalesce("base.citations", F.lit(0))
    days = F.datediff("created_at", "base.created_at")
    gain = (now - C("base.overall_score")) * 100 / F.nullif(C("base.overall_score"), F.lit(0))
    rate = (days >= 1) & (days <= 2 * K.IMPROVEMENT_WINDOW_DAYS) & (gain >= K.IMPROVEMENT_MIN_PERCENT)

    def item(condition: Column, kind: str, name: Column, threshold: Column, previous: Column, current: Column) -> Column:
        return F.when(condition, F.struct(
            F.lit(kind).alias("milestone_type"), name.alias("milestone_key"), threshold.cast("int").alias("threshold"),
            previous.cast("int").alias("previous_value"), current.cast("int").alias("current_value")))

    found = F.array(
        *[item((now >= s) & (before < s), "score_threshold", F.lit(str(s)), F.lit(s), before, now) for s in K.SCORE_THRESHOLDS],
        item((cites > 0) & (base_cites == 0), "citation_milestone", F.lit("first"), F.lit(1), F.lit(0), cites),
        item((base_cites > 0) & (cites >= base_cites * 2), "citation_milestone", F.lit("doubled"), F.lit(2), base_cites, cites),
        item((base_cites > 0) & (cites >= base_cites * 10), "citation_milestone", F.lit("tenfold"), F.lit(10), base_cites, cites),
        item(rate, "improvement_rate", F.lit("any"), round_half_up(gain), C("base.overall_score"), now),
    )
    hits = rows.select("project_id", "created_at", "snapshot_id", F.explode(F.filter(found, lambda m: m.isNotNull())).alias("m")).select(
        "project_id", C("created_at").alias("triggered_at"), "snapshot_id", "m.*")
    mentions = platforms.groupBy("project_id", "platform").agg(F.min("seen_at").alias("triggered_at")).select(
        "project_id", "triggered_at", F.lit(0).cast("long").alias("snapshot_id"), F.lit("first_mention").alias("milestone_type"),
        C("platform").alias("milestone_key"), F.lit(None).cast("int").alias("threshold"),
        F.lit(None).cast("int").alias("previous_value"), F.lit(1).alias("current_value"))
    keys = ["project_id", "milestone_type", "milestone_key"]
    once = latest_per_key(hits.unionByName(mentions), keys, ["triggered_at", "snapshot_id"], first=True)
    return once.join(existing.select(*keys), keys, "left_anti")


def snapshot_types(citations_per_audit: DataFrame) -> DataFrame:
    """Type of each (page, audit) snapshot: ``before`` for the first of a page, ``after`` for all later ones."""
    first = citations_per_audit.groupBy("client_page_id").agg(
        F.min(F.struct("captured_at", "audit_id")).alias("_first"))
    return citations_per_audit.join(first, "client_page_id").withColumn(
        "snapshot_type", F.when(F.struct("captured_at", "audit_id") == C("_first"), "before").otherwise("after")).drop("_first")


def plan_changes(subscriptions: DataFrame, order: list[str]) -> DataFrame:
    """Transition of every plan change of a user: upgrade, downgrade or same, and what it requires.

    ``subscriptions`` (user_id, plan, and the order columns).
    """
    rank = F.create_map(*[x for p in K.PLANS for x in (F.lit(p[0]), F.lit(p[1]))])
    rows = previous_row(subscriptions, ["user_id"], order, ["plan"]).filter(C("previous_plan").isNotNull())
    old, new = F.element_at(rank, C("previous_plan")), F.element_at(rank, C("plan"))
    return rows.withColumns(
        {
            "transition": F.when(new > old, "upgrade").when(new < old, "downgrade").otherwise("same"),
            "requires_checkout": (old == 0) & (new > 0),
            "requires_cancellation": (new == 0) & (old > 0),
            "requires_contact": (C("plan") == "enterprise") | (C("previous_plan") == "enterprise"),
        }
    )


def weekly_history(snapshots: DataFrame, key: str, weeks_back: int, as_of: str) -> DataFrame:
    """Score history arrays: the latest score of each week of the kept period, oldest first.

    The period bounds the array (score history is kept for 52 weeks), so no key grows without limit.
    """
    since = F.date_sub(F.to_date(F.lit(as_of)), 7 * weeks_back)
    recent = snapshots.filter((C("created_at") >= since) & (C("created_at") < F.date_add(F.to_date(F.lit(as_of)), 1)))
    weekly = recent.groupBy(key, F.date_trunc("week", "created_at").alias("week")).agg(
        F.max_by("overall_score", F.struct("created_at", "snapshot_id")).alias("score"))
    return weekly.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("week", "score"))), lambda x: x["score"]).alias("history"))


def locale_deltas(scans: DataFrame) -> DataFrame:
    """Latest score per user and locale and its change to the scan before."""
    rows = previous_row(scans, ["user_id", "locale"], ["scanned_at", "scan_id"], ["score"])
    last = latest_per_key(rows, ["user_id", "locale"], ["scanned_at", "scan_id"])
    return last.select("user_id", "locale", "score", (C("score") - C("previous_score")).alias("delta"))




def heading_skips(headings: DataFrame) -> DataFrame:
    """Neighbouring headings of a page that skip a level going down (exploded form, bounded by a page)."""
    w = Window.partitionBy("page_id").orderBy("position")
    return headings.withColumn("previous_level", F.lag("level").over(w)).filter(C("level") > C("previous_level") + 1)
