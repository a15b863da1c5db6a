"""Streams over files, run to the end with availableNow, against the batch results."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.catalog.jobs import _stream
from sightline.operators import jobs as J
from sightline.operators.matching import keyword_mentions
from sightline.sources.readers import read_answers
from sightline.sources.derived import TestTables
from sightline.streaming import jobs as S

T0 = datetime(2024, 1, 1)


def stream_of(spark, rows, ddl, folder):
    """Each list of rows becomes a file, so that they arrive in separate micro-batches."""
    for part in rows:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, stream, folder):
    S.write_available(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


FAILURE = "queue string, job_id long, ts timestamp"


def test_alert_state_spans_micro_batches(spark, tmp_path):
    first = [("q", i, T0 + timedelta(seconds=i)) for i in range(4)]
    second = [("q", 4, T0 + timedelta(seconds=4)), ("q", 5, T0 + timedelta(seconds=5)), ("q", 6, T0 + timedelta(seconds=700))]
    clock = [(None, None, T0 + timedelta(hours=3))]
    got = run(spark, S.failure_alerts(stream_of(spark, [first, second, clock], FAILURE, str(tmp_path))), str(tmp_path))
    batch = J.failure_alerts(spark.createDataFrame(first + second, FAILURE))
    assert [(r["queue"], r["job_id"]) for r in got.collect()] == [(r["queue"], r["job_id"]) for r in batch.collect()] == [("q", 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_micro_batches_equal_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ppppq"), i, T0 + timedelta(seconds=rng.randrange(0, 9000))) for i in range(400)]
    rows += [("p", 1000 + i, T0 + timedelta(seconds=77)) for i in range(3)]  # equal times
    late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(0, 3500)))  # up to an hour late
    parts = [late[i : i + 140] for i in range(0, len(late), 140)]
    clock = [(None, None, T0 + timedelta(days=2))]
    got = run(spark, S.failure_alerts(stream_of(spark, [*parts, clock], FAILURE, str(tmp_path)), 4, 120, 300), str(tmp_path))
    batch = J.failure_alerts(spark.createDataFrame(rows, FAILURE), 4, 120, 300)
    assert 5 < got.count() == batch.count()
    key = lambda r: (r["queue"], r["at_us"])
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))


def test_rows_wait_outside_of_python(spark, tmp_path):
    rows = [("q", i, T0 + timedelta(minutes=i // 2)) for i in range(600)]  # pairs of equal times
    clock = [(None, None, T0 + timedelta(days=2))]
    alerts = S.failure_alerts(stream_of(spark, [rows[::3], rows[1::3], rows[2::3], clock], FAILURE, str(tmp_path)), 4, 120, 3600, "1 day")
    query = S.write_available(alerts, f"{tmp_path}/out", f"{tmp_path}/state")
    # a timer and a state call of Python for each minute took most of the time
    metrics = [op["customMetrics"] for p in query.recentProgress for op in p["stateOperators"]]
    timers = [m["numRegisteredTimers"] for m in metrics if "numRegisteredTimers" in m]
    assert timers and sum(timers) <= 4
    got = spark.read.parquet(f"{tmp_path}/out").select("queue", "job_id", "at_us", "failures").collect()
    batch = J.failure_alerts(spark.createDataFrame(rows, FAILURE), 4, 120, 3600)
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.select("queue", "job_id", "at_us", "failures").collect())) != []


def test_rows_wait_for_the_watermark(spark, tmp_path):
    rows = [("q", i, T0 + timedelta(seconds=i)) for i in range(9)]
    got = run(spark, S.failure_alerts(stream_of(spark, [rows], FAILURE, str(tmp_path))), str(tmp_path))
    assert got.count() == 0  # an older row could still come


@pytest.mark.parametrize(("cooldown", "block"), [(10, 1), (10, 3), (60, 16), (3600, 16)])
def test_parallel_cooldown_equals_a_loop(spark, cooldown, block):
    rng = random.Random(cooldown + block)
    rows = [(rng.choice(["hot"] * 8 + ["b", "", None]), rng.randrange(0, 6_000) * 500_000, rng.randrange(50)) for _ in range(1500)]
    rows += [("gap", 5_000_000, 1), ("gap", 400_000_000_000, 2)]
    want = []
    for queue in {r[0] for r in rows}:
        last = None
        for at, waiting in sorted(r[1:] for r in rows if r[0] == queue):
            if last is None or at - last >= cooldown * 1_000_000:
                last = at
                want.append((queue, at, waiting))
    df = spark.createDataFrame(rows, "queue string, at_us long, waiting long").repartition(5)
    assert sorted(map(tuple, J.cooled_down(df, cooldown, block).collect()), key=str) == sorted(want, key=str)
    assert J.cooled_down(df.limit(0), cooldown, block).collect() == []


def test_repeats_are_dropped_and_late_rows_with_them(spark, tmp_path):
    ddl = "key string, ts timestamp"
    parts = [[("a", T0), ("a", T0 + timedelta(minutes=1))], [("b", T0 + timedelta(hours=9))], [("a", T0 + timedelta(minutes=2)), ("c", T0 + timedelta(hours=9))]]
    got = run(spark, S.drop_repeats(stream_of(spark, parts, ddl, str(tmp_path)), ["key"], "1 hour"), str(tmp_path))
    assert sorted(r["key"] for r in got.collect()) == ["a", "b", "c"]


def test_stale_sessions(spark, tmp_path):
    ddl = "job_key string, state string, ts timestamp"
    parts = [[("x", "pending", T0), ("y", "pending", T0), ("y", "completed", T0 + timedelta(minutes=5))], [("z", "active", T0 + timedelta(hours=5))]]
    got = run(spark, S.stale_after(stream_of(spark, parts, ddl, str(tmp_path))), str(tmp_path))
    assert [(r["job_key"], r["state"]) for r in got.collect()] == [("x", "pending")]


def test_answers_by_day_are_pruned(spark, tmp_path):
    rows = [(i, i % 2, "chatgpt", "q", T0 + timedelta(days=i), "m", 1, 1, "t") for i in range(6)]
    df = spark.createDataFrame(rows, "snapshot_id long, project_id long, ai_engine string, query_text string, queried_at timestamp, model string, input_tokens long, output_tokens long, text string")
    df.withColumn("day", F.to_date("queried_at")).write.partitionBy("day").parquet(f"{tmp_path}/answers")
    got = read_answers(spark, f"{tmp_path}/answers", project_id=1, start=T0 + timedelta(days=2), end=T0 + timedelta(days=5))
    assert sorted(r["snapshot_id"] for r in got.collect()) == [3, 5]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull" in plan


def test_another_sentiment_classifier(spark):
    @F.pandas_udf("string")
    def loud(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "positive" if "!" in t else "neutral")

    posts = spark.createDataFrame([("p1", "s", "Acme!", None, 1)], "reddit_id string, subreddit string, title string, body string, score int")
    comments = spark.createDataFrame([("c1", "p1", "acme", 1), ("c2", "p9", "acme", 1)], "reddit_id string, post_id string, body string, score int")
    keywords = spark.createDataFrame([(1, "acme", True), (1, " ", True), (2, "acme", False)], "brand_id long, keyword string, enabled boolean")
    got = {r["mention_id"]: (r["brand_id"], r["sentiment"]) for r in keyword_mentions(posts, comments, keywords, loud).collect()}
    assert got == {"p1": (1, "positive"), "c1": (1, "neutral")}


OBSERVED = "project_id long, ts timestamp, is_mention boolean, is_citation boolean, rank double"
RULES = "rule_id long, project_id long, type string, threshold double, cooldown_minutes int, last_fired_at timestamp, enabled boolean"


@pytest.mark.parametrize("seed", [3, 4])
def test_streamed_rules_equal_a_loop_over_batch_metrics(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, None]), T0 + timedelta(seconds=rng.randrange(0, 80_000)), rng.random() < 0.6, rng.random() < 0.1, rng.choice([None, 1.0, 9.0])) for _ in range(300)]
    rules = [
        (10, 1, "visibility_drop", None, 90, None, True), (11, 1, "visibility_drop", 1.0, 0, None, True), (12, 1, "new_citation", None, None, T0 - timedelta(minutes=200), True),
        (13, 2, "competitor_gain", 0.5, 120, None, True), (14, 1, "unheard", None, None, None, True), (15, 1, "new_citation", None, None, None, False),
        (16, 9, "new_citation", None, None, None, True), (17, None, "new_citation", None, None, None, True)]
    late = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(0, 3500)))
    clock = [(None, T0 + timedelta(days=3), None, None, None)]
    stream = stream_of(spark, [late[:100], late[100:170], late[170:], clock], OBSERVED, str(tmp_path))
    static = spark.createDataFrame(rules, RULES)
    got = run(spark, S.rule_alerts(stream, static, "1 hour"), str(tmp_path)).collect()

    metrics = J.period_metrics(spark.createDataFrame(rows, OBSERVED), "1 hour").withColumn("end", F.col("w.end")).drop("w")
    want, ends = [], sorted(r["end"] for r in metrics.select("end").distinct().collect())
    fired = {r[0]: r[5] for r in rules}
    for end in ends:
        now = [(*r[:5], fired[r[0]], r[6]) for r in rules]
        for r in J.evaluate_alerts(spark.createDataFrame(now, RULES), metrics.filter(F.col("end") == F.lit(end)), end).collect():
            want.append((r["rule_id"], r["type"], end, r["outcome"], r["value"]))
            if r["outcome"] == "fired":
                fired[r["rule_id"]] = end
    assert sorted((r["rule_id"], r["type"], r["period_end"], r["outcome"], r["value"]) for r in got) == sorted(want)
    assert {w[3] for w in want} == {"fired", "quiet", "cooled_down"} and not {15, 16, 17} & {w[0] for w in want}


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_a_stream_as_a_file_and_as_a_folder(spark, tmp_path, files):
    rows = spark.range(30).withColumnRenamed("id", "event_id")
    path = tmp_path / "sf" / "events.parquet"
    rows.repartition(files).write.parquet(str(path if files > 1 else tmp_path / "one"))
    spark.range(5).write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    if files == 1:
        next((tmp_path / "one").glob("part-*")).rename(path)
    stream = _stream(TestTables(spark, str(tmp_path / "sf")), "events")
    assert run(spark, stream, str(tmp_path)).count() == 30
