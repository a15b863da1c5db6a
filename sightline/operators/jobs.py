"""Periodic jobs over schedules, queues, deliveries and stored data.

Cooldowns depend on what was decided before. In batch a queue's time is cut into blocks that run in parallel: each block says, for
every row that could be its first decision, which decisions follow and which is the last (``cooled_down``); only these
ends are chained per queue. On streams the same rules run as steps with managed state (``sightline.streaming``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import dates
from sightline.functions.numbers import round_half_up
from sightline.operators.skew import latest_per_key
from sightline.session import shared_table

C = F.col
Step = Callable[[object, pd.DataFrame], tuple[pd.DataFrame, object]]


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """Fold the rows of each key in order. Spark sorts and spills; Python sees batches and keeps one key's state.

    ``step(state, rows)`` gets consecutive rows of one key and returns output rows and the new state.
    """
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            for key, rows in pdf.groupby(keys, sort=False, dropna=False):
                if key != current:
                    current, state = key, None
                out, state = step(state, rows)
                if len(out):
                    yield out

    return ordered.mapInPandas(run, schema)


# --- steps ----------------------------------------------------------------------------------------


def chain(at: np.ndarray, cooldown_us: int) -> np.ndarray:
    """For each of the sorted times, the index of the first one at least a cooldown later (their number, if there is none)."""
    return np.searchsorted(at, at + cooldown_us)


def cooldown_step(cooldown_us: int) -> Step:
    """Keep the first row and then the first one at least a cooldown after the last kept."""

    def step(last: int | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, int | None]:
        at = rows["at_us"].to_numpy()
        after, picked = chain(at, cooldown_us), []
        i = 0 if last is None else int(np.searchsorted(at, last + cooldown_us))
        while i < len(at):
            picked.append(i)
            last = int(at[i])
            i = int(after[i])
        return rows.iloc[picked], last

    return step


#: a block of time lasts so many cooldowns
BLOCK_COOLDOWNS = 16


def cooled_down(df: DataFrame, cooldown_seconds: int, block_cooldowns: int = BLOCK_COOLDOWNS) -> DataFrame:
    """Of the rows (queue, at_us, ...), per queue the first and then each first one at least a cooldown after the last kept.

    Of one instant only the least row can be kept. A block's table has one entry for each row of its first cooldown (and the next row), with the decisions that
    follow from it; a block holds at most one more decision than cooldowns. The chain over a queue's blocks reads
    only (first time, last decision) of the entries, so a queue with most of all rows is as many tasks as it has blocks.
    """
    us = cooldown_seconds * 1_000_000
    payload = [c for c in df.columns if c not in ("queue", "at_us")]
    named = F.coalesce(F.concat(F.lit("="), C("queue")), F.lit(""))  # rows without a queue are a queue of their own
    rows = df.withColumn("queue", named).groupBy("queue", "at_us").agg(F.min(F.struct(F.lit(0).alias("_"), *payload)).alias("_row"))
    rows = rows.select("queue", "at_us", *[f"_row.{c}" for c in payload])
    rows = rows.withColumn("block", F.floor(C("at_us") / (us * block_cooldowns)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fired = "array<struct<at_us: bigint" + "".join(f", {c}: {kinds[c]}" for c in payload) + ">>"
    fields = ["at_us", *payload]

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None

        def out() -> pd.DataFrame:
            own = pd.concat(held, ignore_index=True)
            at = own["at_us"].to_numpy()
            after, values = chain(at, us), list(zip(*(own[c].tolist() for c in fields), strict=True))
            first = int(np.searchsorted(at, (key[1] * block_cooldowns + 1) * us))
            found = []
            for i in range(min(first + 1, len(at))):
                way = [i]
                while after[way[-1]] < len(at):
                    way.append(int(after[way[-1]]))
                found.append((key[0], key[1], int(at[i]), int(at[way[-1]]), [dict(zip(fields, values[k], strict=True)) for k in way]))
            return pd.DataFrame(found, columns=["queue", "block", "first", "last", "fired"])

        for pdf in batches:
            for own_key, own in pdf.groupby(["queue", "block"], sort=False, dropna=False):
                if held and own_key != key:
                    yield out()
                    held = []
                key = own_key
                held.append(own)
        if held:
            yield out()

    by_block = rows.repartition("queue", "block").sortWithinPartitions("queue", "block", "at_us")
    found = shared_table(by_block.mapInPandas(entries, f"queue string, block long, first long, last long, fired {fired}"), "cooldowns")

    def choose(state: tuple | None, own: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        last, taken = state or (None, None)
        picked = []
        block, first, end = (own[c].to_numpy() for c in ("block", "first", "last"))
        for i in range(len(own)):
            if block[i] != taken and (last is None or first[i] >= last + us):
                taken, last = int(block[i]), int(end[i])
                picked.append(i)
        return own.iloc[picked][["queue", "block", "first"]], (last, taken)

    chosen = fold_sorted(found.select("queue", "block", "first", "last"), ["queue"], ["block", "first"], choose, "queue string, block long, first long")
    return found.join(chosen, ["queue", "block", "first"]).select(
        F.when(C("queue") != "", F.substr("queue", F.lit(2))).alias("queue"), F.explode("fired").alias("f")
    ).select("queue", *[f"f.{c}" for c in fields])


def failure_step(threshold: int, window_us: int, cooldown_us: int) -> Step:
    """Failures instant by instant: an alert, for the first row, when the window holds enough of them and the cooldown is over.
    The rows of an instant come together and all count."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        recent, last = (deque(), None) if state is None else (deque(state[0]), state[1])
        picked, counts = [], []
        times = rows["at_us"].to_numpy()
        starts = np.flatnonzero(np.append(True, times[1:] != times[:-1])).tolist()
        for i, end in zip(starts, [*starts[1:], len(times)], strict=True):
            at = int(times[i])
            recent.extend([at] * (end - i))
            while recent[0] <= at - window_us:
                recent.popleft()
            if len(recent) >= threshold and (last is None or at - last >= cooldown_us):
                last = at
                picked.append(i)
                counts.append(len(recent))
        return rows.iloc[picked].assign(failures=counts), (list(recent), last)

    return step


# --- alerts ---------------------------------------------------------------------------------------


def failures_in_window(failures: DataFrame, key: str, window_seconds: int) -> DataFrame:
    """Number of failures in the window up to each failure.

    Rows are copied to their own and the next time bucket, so a window lies within one (key, bucket) and no key is
    sorted as a whole.
    """
    us = window_seconds * 1_000_000
    rows = failures.withColumn("at_us", F.unix_micros(C("ts").cast("timestamp")))
    own = F.floor(C("at_us") / us)
    copies = rows.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(key, "_bucket").orderBy("at_us").rangeBetween(-(us - 1), 0)
    return copies.withColumn("failures", F.count(F.lit(1)).over(w)).filter(C("_own") == C("_bucket")).drop("_own", "_bucket")


def failure_alerts(failures: DataFrame, threshold: int = 5, window_seconds: int = 600, cooldown_seconds: int = 600) -> DataFrame:
    """Alerts per queue: the windows at or over the threshold, thinned by the cooldown.

    The counts are a distributed window; only rows over the threshold go through the cooldown.
    """
    hot = failures_in_window(failures.select("queue", "job_id", "ts"), "queue", window_seconds).filter(C("failures") >= threshold)
    return cooled_down(hot.select("queue", "at_us", "job_id", "failures"), cooldown_seconds).select("queue", "job_id", "at_us", "failures")


def backlog_alerts(gauges: DataFrame, threshold: int = 100, cooldown_seconds: int = 600) -> DataFrame:
    """Alerts for gauge readings (queue, ts, waiting) over a threshold, thinned by the cooldown."""
    hot = gauges.filter(C("waiting") > threshold).select("queue", F.unix_micros(C("ts").cast("timestamp")).alias("at_us"), "waiting")
    return cooled_down(hot, cooldown_seconds)


def _visibility_drop() -> tuple[Column, Column]:
    drop = (C("previous_mentions") - C("current_mentions")) * 100 / F.nullif("previous_mentions", F.lit(0))
    return F.coalesce(drop >= F.coalesce("threshold", F.lit(20.0)), F.lit(False)), -round_half_up(drop)


def _new_citation() -> tuple[Column, Column]:
    return C("new_citations") > 0, C("new_citations")


def _competitor_gain() -> tuple[Column, Column]:
    loss = C("current_rank") - C("previous_rank")
    return F.coalesce(loss >= F.coalesce("threshold", F.lit(3.0)), F.lit(False)), loss


RULE_TYPES: dict[str, Callable[[], tuple[Column, Column]]] = {
    "visibility_drop": _visibility_drop, "new_citation": _new_citation, "competitor_gain": _competitor_gain,
}


def rule_columns(types: dict[str, Callable[[], tuple[Column, Column]]] | None = None) -> tuple[Column, Column]:
    """Whether the rule of a row fires on the metrics beside it, and the value it would report; unknown types never fire."""
    fires, value = F.lit(False), F.lit(None).cast("double")
    for name, build in (RULE_TYPES if types is None else types).items():
        condition, measured = build()
        fires = F.when(C("type") == name, condition).otherwise(fires)
        value = F.when(C("type") == name, measured.cast("double")).otherwise(value)
    return fires, value


def cooldown_minutes() -> Column:
    return F.coalesce("cooldown_minutes", F.lit(K.ALERT_COOLDOWN_MINUTES))


def evaluate_alerts(
    rules: DataFrame, metrics: DataFrame, as_of: datetime, types: dict[str, Callable[[], tuple[Column, Column]]] | None = None
) -> DataFrame:
    """Outcome of each enabled rule of a project: cooled_down, fired or quiet; unknown types never fire.

    ``rules`` (rule_id, project_id, type, threshold, cooldown_minutes, last_fired_at, enabled), ``metrics``
    (project_id, current_mentions, previous_mentions, current_rank, previous_rank, new_citations).
    """
    j = rules.filter("enabled").join(metrics, "project_id")
    fires, value = rule_columns(types)
    age = F.lit(as_of).cast("timestamp").cast("long") - C("last_fired_at").cast("timestamp").cast("long")
    cooling = F.coalesce(age < cooldown_minutes() * 60, F.lit(False))
    return j.select(
        "rule_id", "project_id", "type", F.when(cooling, "cooled_down").when(fires, "fired").otherwise("quiet").alias("outcome"),
        F.when(~cooling & fires, value).alias("value"))


def _twice(period: str) -> str:
    count, unit = period.split()
    return f"{2 * int(count)} {unit}"


def period_metrics(observations: DataFrame, period: str = "1 day") -> DataFrame:
    """Metrics of each project at the end of each period, beside those of the period before; of batches and of streams.

    ``observations``: (project_id, ts, is_mention, is_citation, rank), the rank null where a row has none. A row counts in two
    windows of twice the period: in the later half of one it is current, in the earlier half of the next previous. Periods
    without rows in either half have no metrics.
    """
    rows = observations.withColumn("w", F.window("ts", _twice(period), period))
    now = C("ts") >= C("w.start") + F.expr(f"INTERVAL {period}")
    halves = rows.select(
        "project_id", "w", (now & C("is_mention")).alias("current"), (~now & C("is_mention")).alias("previous"),
        F.when(now, C("rank")).alias("rank_now"), F.when(~now, C("rank")).alias("rank_before"), (now & C("is_citation")).alias("cited"))
    return halves.groupBy("project_id", "w").agg(
        F.count_if("current").alias("current_mentions"), F.count_if("previous").alias("previous_mentions"),
        F.avg("rank_now").alias("current_rank"), F.avg("rank_before").alias("previous_rank"), F.count_if("cited").alias("new_citations"))


# --- rate limits ------------------------------------------------------------------------------------


def window_counts(requests: DataFrame, window: str = "60 seconds") -> DataFrame:
    """Requests per client and fixed window of a log (client, ts, max_requests), and how many of them the limit accepts and refuses."""
    counts = requests.groupBy("client", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.max("max_requests").alias("limit"))
    return counts.select(
        "client", C("w.start").alias("window_start"), "requests", F.least("requests", "limit").cast("long").alias("accepted"),
        F.greatest(C("requests") - C("limit"), F.lit(0)).cast("long").alias("refused"))


def limit_of(group: Column, plan: Column) -> Column:
    """Requests per window of an endpoint group and plan; anonymous where there is no plan."""
    key = F.concat_ws("/", group, F.coalesce(plan, F.lit("anonymous")))
    table = F.create_map(*[F.lit(x) for g, plans in K.RATE_LIMITS.items() for p, n in plans.items() for x in (f"{g}/{p}", n)])
    return F.try_element_at(table, key)


# --- schedules and sweeps -----------------------------------------------------------------------------


def due_schedules(schedules: DataFrame, as_of: datetime) -> DataFrame:
    """Enabled schedules that are due: the task to emit and the next run."""
    now = F.lit(as_of).cast("timestamp")
    due = schedules.filter(C("enabled") & (C("next_run_at") <= F.lit(as_of)))
    next_run = F.timestamp_seconds(F.unix_timestamp(now) + dates.step(C("frequency")) * 3600)
    return due.select(
        "schedule_id", "project_id",
        F.concat_ws("_", F.lit("ai-vis_sched"), "project_id", F.unix_millis(C("next_run_at").cast("timestamp"))).alias("task_key"), next_run.alias("next_run_at"))


def daily_sweep(projects: DataFrame, schedules: DataFrame, day: str) -> DataFrame:
    """One task per project without an enabled schedule, keyed by project and day."""
    scheduled = schedules.filter("enabled").select("project_id")
    rows = projects.join(scheduled, "project_id", "left_anti").filter(F.btrim("keyword") != "")
    return rows.groupBy("project_id").agg(F.min("keyword").alias("keyword")).select(
        "project_id", F.concat(F.lit("Was ist "), "keyword", F.lit("?")).alias("query_text"),
        F.concat_ws(":", F.lit("ai-vis"), "project_id", F.lit(day)).alias("task_key"))


def stale_jobs(jobs: DataFrame, as_of: datetime, minutes: int = 30) -> DataFrame:
    """Jobs whose latest state has been pending or processing for longer than the limit."""
    last = latest_per_key(jobs.select("job_key", "state", "ts"), ["job_key"], ["ts", "state"])
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    return last.filter(C("state").isin("pending", "processing", "waiting", "active") & (C("ts").cast("timestamp") < cut))


def retained(df: DataFrame, time: str, keep_days: int | Column, as_of: datetime) -> DataFrame:
    """Rows younger than the retention; ``keep_days`` may depend on the row (for example its plan)."""
    days = F.lit(keep_days) if isinstance(keep_days, int) else keep_days
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(C(time).cast("timestamp"))
    return df.filter(age <= days * 86400)


def retention_days(plan: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in K.PLAN_RETENTION_DAYS.items() for x in kv]), plan)


def purge_html(pages: DataFrame, time: str, as_of: datetime, hours: int = K.HTML_RETENTION_HOURS) -> DataFrame:
    """Null out page bodies past their retention; the rows stay."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(C(time).cast("timestamp"))
    return pages.withColumn("html", F.when(age <= hours * 3600, C("html")))


# --- deliveries, queues, mail ----------------------------------------------------------------------------


def delivery_outcomes(attempts: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Status per delivery: delivered, failed, or dead_letter once the last allowed attempt failed."""
    order = F.struct("attempted_at", "attempt_id")
    out = attempts.groupBy("delivery_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.max_by("http_status", order).alias("last_status"),
        F.bool_or(C("http_status").between(200, 299)).alias("_ok"))
    return out.select(
        "delivery_id", "attempts", "last_status",
        F.when(C("_ok"), "delivered").when(C("attempts") >= max_attempts, "dead_letter").otherwise("failed").alias("status"))


def locale_fan_out(scans: DataFrame, locales: DataFrame) -> DataFrame:
    """One task per scan and locale of its domain; the primary locale comes first (priority 1, others 10)."""
    return scans.join(locales, "domain").select(
        "scan_id", "locale", F.when(C("is_primary"), 1).otherwise(10).alias("priority"))


STATES = ("waiting", "active", "completed", "failed", "delayed", "paused")


def queue_metrics(jobs: DataFrame, queues: DataFrame) -> DataFrame:
    """Job counts per queue and state; a queue without any reading is marked as an error (partial snapshot).

    The state table of a queue is one conditional aggregate over the latest state of each job.
    """
    last = jobs.groupBy("queue", "job_id").agg(F.max_by("state", F.struct("ts", "state")).alias("state"))
    counts = last.groupBy("queue").agg(*[F.count_if(C("state") == s).alias(s) for s in STATES], F.lit(True).alias("_read"))
    j = queues.select("queue").join(counts, "queue", "left")
    return j.select("queue", *[F.coalesce(s, F.lit(0)).alias(s) for s in STATES], C("_read").isNull().alias("error"))


def service_health(metrics: DataFrame, backlog: int = 100) -> DataFrame:
    return metrics.agg(
        F.sum("waiting").alias("waiting"), F.sum("failed").alias("failed"), F.bool_or("error").alias("partial"),
        F.when(F.bool_or(C("waiting") > backlog), "degraded").otherwise("ready").alias("status"))


def send_list(messages: DataFrame, sent: DataFrame, preferences: DataFrame) -> DataFrame:
    """Status of each message: deduplicated, suppressed or queued.

    ``messages`` (message_id, user_id, category, idempotency_key), ``sent`` (idempotency_key), ``preferences``
    (user_id, category, enabled). Repeats inside the batch count as well; transactional mail always passes.
    """
    first = messages.filter(C("idempotency_key").isNotNull()).groupBy("idempotency_key").agg(F.min("message_id").alias("_first"))
    known = sent.select("idempotency_key", F.lit(True).alias("_sent")).distinct()
    off = preferences.filter(~C("enabled")).select("user_id", "category", F.lit(True).alias("_off")).distinct()
    j = messages.join(first, "idempotency_key", "left").join(known, "idempotency_key", "left").join(off, ["user_id", "category"], "left")
    repeat = C("_sent") | (C("_first") < C("message_id"))
    return j.select(
        "message_id", F.when(repeat, "deduplicated").when((C("category") != "transactional") & C("_off"), "suppressed").otherwise("queued").alias("status"))
