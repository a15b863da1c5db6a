"""Structured Streaming forms of the incremental jobs.

Time is event time. Late rows beyond the watermark are dropped, state is kept per key, and sinks can be replayed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from sightline.operators.jobs import Step, cooldown_minutes, cooldown_step, failure_step, period_metrics, rule_columns
from sightline.plans.answer_mining import facts, mined_answers

C = F.col


LATE = "1 hour"


def _timed(stream: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp with a watermark, and in microseconds for the steps."""
    return stream.withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))


#: rows wait for the watermark in windows of this length
WAIT_SECONDS = 60


class OrderedFold(StatefulProcessor):
    """Folds the rows of a key in event-time order, micro-batch by micro-batch.

    The rows of a micro-batch all come after those of earlier ones, as the windows before release them by watermark; so it is
    enough to sort a micro-batch by (at_us, tie). State is the fold's value. Rows without a key are clock
    readings: they moved the watermark and are not folded. The value of a key that had no rows for ``idle_ms`` is dropped.
    """

    def __init__(self, step: Step, columns: list[str], value_ddl: str, idle_ms: int) -> None:
        self.step, self.columns, self.value_ddl, self.idle_ms = step, columns, value_ddl, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.value_ddl}, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] is None:
            return
        due = pd.concat([own[self.columns] for own in rows]).sort_values(self.columns, kind="stable", ignore_index=True)
        state = self.value.get() if self.value.exists() else None
        if state is not None:
            self.handle.deleteTimer(state[-1] + self.idle_ms)
        out, folded = self.step(None if state is None else tuple(state[:-1]), due)
        seen = int(due["at_us"].iloc[-1]) // 1000
        self.value.update((*folded, seen))
        self.handle.registerTimer(seen + self.idle_ms)
        if len(out):
            yield out.assign(queue=key[0])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ordered(rows: DataFrame, step: Step, columns: list[str], value_ddl: str, idle_seconds: int, schema: str) -> DataFrame:
    """The fold of each queue's rows (queue, ts, and ``columns`` with at_us first).

    Rows wait in windows of event time, by queue and window on all executors; a window is released once the watermark has passed
    its end, so nothing older can come. Only the released rows of a queue meet in the fold.
    """
    windows = rows.groupBy("queue", F.window("ts", f"{WAIT_SECONDS} seconds").alias("w")).agg(F.collect_list(F.struct(*columns)).alias("waiting"))
    released = windows.select("queue", F.window_time("w").alias("ts"), F.inline("waiting"))
    fold = OrderedFold(step, columns, value_ddl, 1000 * (idle_seconds + WAIT_SECONDS))
    return released.groupBy("queue").transformWithStateInPandas(fold, schema, "append", "eventtime")


def failure_alerts(
    failures: DataFrame, threshold: int = 5, window_seconds: int = 600, cooldown_seconds: int = 600, late: str = LATE
) -> DataFrame:
    """Alerts on a stream of terminal failures (queue, job_id, ts), equal to the batch result for rows that come within ``late`` of the newest.
    Rows with a null queue only move the clock."""
    fold = failure_step(threshold, window_seconds * 1_000_000, cooldown_seconds * 1_000_000)

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        out, (recent, last) = fold(None if state is None else (list(state[0]), state[1]), rows)
        return out, (recent, last)

    rows = _timed(failures, late).select("queue", "job_id", "ts", "at_us")
    return _ordered(
        rows, step, ["at_us", "job_id"], "recent array<long>, last long", max(window_seconds, cooldown_seconds),
        "queue string, job_id long, at_us long, failures long")


def backlog_alerts(gauges: DataFrame, threshold: int = 100, cooldown_seconds: int = 600, late: str = LATE) -> DataFrame:
    """Alerts on a stream of gauge readings (queue, ts, waiting). Rows with a null queue only move the clock."""
    fold = cooldown_step(cooldown_seconds * 1_000_000)

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        out, last = fold(None if state is None else state[0], rows)
        return out, (last,)

    rows = _timed(gauges.filter((C("waiting") > threshold) | C("queue").isNull()), late).select("queue", "ts", "at_us", "waiting")
    return _ordered(rows, step, ["at_us", "waiting"], "last long", cooldown_seconds, "queue string, at_us long, waiting long")


class RuleCooldown(StatefulProcessor):
    """Outcomes of a rule, period by period: a rule that fired stays silent until its cooldown is over.

    The periods of a micro-batch all end after those of earlier ones, as the aggregation before releases them by watermark;
    so it is enough to go through the rows of a micro-batch by time. State is the time of the last alert.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fired_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = pd.concat(rows).sort_values("end_us", kind="stable", ignore_index=True)
        known = self.last.get()[0] if self.last.exists() else None
        outcomes = []
        for end, fires, cooldown, given in zip(due["end_us"], due["fires"], due["cooldown_us"], due["given_us"], strict=True):
            last = known if known is not None else None if pd.isna(given) else int(given)
            cooling = last is not None and end - last < cooldown
            if fires and not cooling:
                known = int(end)
            outcomes.append("cooled_down" if cooling else "fired" if fires else "quiet")
        if known is not None:
            self.last.update((known,))
        due["outcome"] = outcomes
        due["value"] = due["value"].where(due["outcome"] == "fired").astype("float64")
        yield due[["rule_id", "project_id", "type", "end_us", "outcome", "value"]]

    def close(self) -> None:
        pass


def rule_alerts(observations: DataFrame, rules: DataFrame, period: str = "1 day", late: str = LATE) -> DataFrame:
    """(rule_id, project_id, type, period_end, outcome, value): each enabled rule of a project at the end of each period.

    ``observations`` is a stream (project_id, ts, is_mention, is_citation, rank), ``rules`` a table as in ``evaluate_alerts``. One
    watermark serves both stateful operators: it closes a period, whose metrics meet the rules, and the cooldown of
    each rule follows. A rule's own ``last_fired_at`` holds until it fires here. Rows with a null project
    only move the clock.
    """
    metrics = period_metrics(observations.withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", late), period)
    fires, value = rule_columns()
    # a plain equality would let the optimizer drop rows without a project before they can move the clock
    own = rules.filter("enabled AND project_id IS NOT NULL").withColumnRenamed("project_id", "rule_project")
    tried = metrics.join(own, C("project_id").eqNullSafe(C("rule_project"))).select(
        "rule_id", "project_id", "type", F.unix_micros("w.end").alias("end_us"), fires.alias("fires"), value.alias("value"),
        (cooldown_minutes().cast("long") * 60_000_000).alias("cooldown_us"), F.unix_micros(C("last_fired_at").cast("timestamp")).alias("given_us"))
    kinds = {f.name: f.dataType.simpleString() for f in tried.schema.fields}
    out = tried.groupBy("rule_id").transformWithStateInPandas(
        RuleCooldown(), f"rule_id {kinds['rule_id']}, project_id {kinds['project_id']}, type string, end_us long, outcome string, value double", "append", "none")
    return out.select("rule_id", "project_id", "type", F.timestamp_micros("end_us").alias("period_end"), "outcome", "value")


def failure_counts(failures: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """The simple form: failures per queue and event-time window. In append mode a window is emitted once the watermark
    has passed it; with ``write_updates`` the open windows are there as well."""
    rows = failures.withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", late)
    counts = rows.groupBy("queue", F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("failures"))
    return counts.select("queue", C("window.start").alias("window_start"), "failures")


def drop_repeats(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Suppress repeated keys that arrive within the watermark of each other."""
    return rows.withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stale_after(jobs: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Sessions of job events that ended without a final state: emitted when the gap has passed."""
    rows = jobs.withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", late)
    sessions = rows.groupBy("job_key", F.session_window("ts", f"{minutes} minutes")).agg(
        F.max_by("state", "ts").alias("state"), F.max("ts").alias("last_seen"))
    return sessions.filter(C("state").isin("pending", "processing", "waiting", "active")).select("job_key", "state", "last_seen")


# --- running ------------------------------------------------------------------------------------------

#: state on the executors' disks, so that it may outgrow their memory
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keep_state(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and append it to a table, exactly once by checkpoint."""
    _keep_state(stream)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and write the changed rows of each micro-batch to a folder of its own, which a replay
    overwrites. A reader takes the latest batch of each key (``latest_updates``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _keep_state(stream)
    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def mine_stream(
    answers: DataFrame, config: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """New answers to fact tables. A replayed micro-batch overwrites its own folder, so facts appear once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        store = f"{path}/mined/batch={batch_id}"
        mined_answers(rows, config).write.mode("overwrite").parquet(store)
        for name, table in facts(rows.sparkSession.read.parquet(store)).tables().items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    query = answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_facts(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")
