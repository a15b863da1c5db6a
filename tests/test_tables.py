"""Helpers against hot keys, sinks, paging, crawl and jobs on small tables."""

import random
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline import catalog
from sightline.operators import business as B
from sightline.operators import crawl as W
from sightline.operators import jobs as J
from sightline.operators import paging as P
from sightline.operators import series as S
from sightline.operators.prompts import render_templates
from sightline.operators.skew import latest_per_key, ordinal, previous_row, previous_values, top_k_per_key
from sightline.sources import sinks
from sightline.sources.derived import TestTables

C = F.col
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """One key with most of the rows, a key that is null, and months without rows."""
    rng = random.Random(5)
    rows = [(None if i % 40 == 0 else 1 if i % 3 else i % 7, T0 + timedelta(days=rng.choice([0, 1, 40, 41, 200, 201]), hours=rng.randint(0, 9)), i, rng.randint(0, 50)) for i in range(300)]
    return spark.createDataFrame(rows, "k int, t timestamp, id long, v int").cache()


def test_previous_row_equals_a_plain_lag(hot):
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = hot.select("id", F.lag("v").over(w).alias("p"), F.row_number().over(w).cast("long").alias("n"))
    split = previous_row(hot, ["k"], ["t", "id"], ["v"]).select("id", C("previous_v").alias("p"))
    numbered = ordinal(hot, ["k"], ["t", "id"]).select("id", C("ordinal").cast("long").alias("n"))
    assert {r["id"]: r["p"] for r in split.collect()} == {r["id"]: r["p"] for r in plain.collect()}
    assert {r["id"]: r["n"] for r in numbered.collect()} == {r["id"]: r["n"] for r in plain.collect()}


def test_previous_values_equal_plain_lags(hot):
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = hot.select("id", F.array_compact(F.array(*[F.lag("v", i).over(w) for i in (1, 2, 3)])).alias("p"))
    got = previous_values(hot, ["k"], ["t", "id"], "v", 3)
    assert {r["id"]: r["previous"] for r in got.collect()} == {r["id"]: r["p"] for r in plain.collect()}


def test_latest_and_top_k(hot):
    w = Window.partitionBy("k").orderBy(C("t").desc(), C("id").desc())
    plain = hot.withColumn("n", F.row_number().over(w))
    assert {r["id"] for r in latest_per_key(hot, ["k"], ["t", "id"]).collect()} == {r["id"] for r in plain.filter("n = 1").collect()}
    top = top_k_per_key(hot, ["k"], [C("t").desc(), C("id").desc()], 3)
    assert {r["id"] for r in top.collect()} == {r["id"] for r in plain.filter("n <= 3").collect()}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_trend_labels(spark):
    rows = [(k, T0 + timedelta(days=i), i, s) for k, scores in {1: [10, 50, 50, 50, 11], 2: [0, 5], 3: [7], 4: [100, 104]}.items() for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "k int, t timestamp, id int, v int")
    got = {r["k"]: r["trend"] for r in S.latest_trends(df, "k", [C("t").desc()], "v").collect()}
    assert got == {1: "declining", 2: "improving", 3: "stable", 4: "stable"}


def test_commission_tiers_and_custom_rates(spark):
    rows = [(i, 1, 1, 1000, T0 + timedelta(days=9 * i), 99_999 if i == 3 else None) for i in range(52)] + [(99, 2, 1, 0, T0, None)]
    df = spark.createDataFrame(rows, "invoice_id long, affiliate_id long, user_id long, net_cents long, paid_at timestamp, custom_rate_bps int")
    got = {r["invoice_id"]: r["rate_bps"] for r in B.commissions(df).collect()}
    assert (got[0], got[3], got[9], got[10], got[50]) == (2000, 10_000, 2000, 2500, 3000) and 99 not in got


def test_csv_file(spark, tmp_path):
    reg = sinks.ExporterRegistry()
    df = spark.createDataFrame([(1, 'say "hi", ok', T0, [1, 2]), (2, None, T0 + timedelta(days=9), [])], "id int, note string, at timestamp, xs array<int>")
    reg.register("notes", lambda: df, ["id", "note", "at", "xs"], ["id", "note"], "at")
    with pytest.raises(ValueError, match="unknown columns"):
        reg.export("notes", ["secret"])
    out = str(tmp_path / "csv")
    sinks.write_csv(reg.export("notes", ["id", "note", "at", "xs"], T0, T0 + timedelta(days=1)), out)
    parts = sorted(p for p in Path(out).rglob("part-*") if p.stat().st_size)
    data = b"".join(p.read_bytes() for p in parts).decode()
    assert data == '﻿id,note,at,xs\r\n1,"say ""hi"", ok",2024-01-01T00:00:00.000Z,"[1,2]"\r\n'


def test_bi_fields_are_checked_first(spark):
    with pytest.raises(ValueError, match="unknown fields"):
        sinks.bi_extract(spark.range(1), {}, ["nope"])
    assert sinks.bi_schema(["citation_count"])[0]["aggregation"] == "COUNT"


def test_upsert_and_insert_absent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 7)], "id int, x string, link int")
    new = spark.createDataFrame([(1, "A", 5), (2, "B", 9), (3, "C", 1)], "id int, x string, link int")
    got = {r["id"]: (r["x"], r["link"]) for r in sinks.upsert(old, new, ["id"], keep=("link",)).collect()}
    assert got == {1: ("A", 5), 2: ("B", 7), 3: ("C", 1)}
    doubled = new.unionByName(new.withColumn("x", F.lit("z")))
    assert [(r["id"], r["x"]) for r in sinks.insert_absent(old, doubled, ["id"], ["x"]).collect()] == [(3, "C")]


def test_cursor_codec_and_list_requests():
    token = P.encode_cursor("2024-01-01T00:00:00Z", 7, b"key")
    assert P.decode_cursor(token, b"key") == ("2024-01-01T00:00:00Z", 7)
    with pytest.raises(ValueError):
        P.decode_cursor(token[:-2] + "xx", b"key")
    with pytest.raises(ValueError):
        P.decode_cursor("%%%")
    for params, code in (({"limit": "0"}, "INVALID_LIMIT"), ({"fields": "id,x"}, "INVALID_FIELDS"), ({"sort": "-id"}, "INVALID_SORT")):
        with pytest.raises(P.RequestError) as e:
            P.parse_list_request(params, ["id"], ["score"])
        assert e.value.code == code
    assert P.parse_list_request({"limit": "999", "id": "3"}, ["id"], []).limit == 100


def test_hmac_tag(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("m",)], "m string").select(P.hmac_sha256(C("m"), b"secret").alias("t")).collect()[0]["t"]
    assert got == hmac.new(b"secret", b"m", hashlib.sha256).hexdigest()


def test_pages_follow_one_another_without_gaps(spark):
    df = spark.createDataFrame([(T0 + timedelta(hours=i // 3), i) for i in range(20)], "t timestamp, id long")
    seen, cursor = [], None
    while True:
        rows = P.keyset_page(df, "t", "id", 6, cursor).collect()
        seen += [r["id"] for r in rows[:6]]
        if len(rows) <= 6:
            break
        cursor = (rows[5]["t"], rows[5]["id"])
    assert seen == list(range(19, -1, -1))


def test_crawl_cap_and_depth(spark):
    url = lambda i: f"https://s.example/p{i}"
    edges = spark.createDataFrame([(1, url(i), url(j)) for i in range(40) for j in (2 * i + 1, 2 * i + 2, 0)], "crawl_id long, url string, link string")
    roots = spark.createDataFrame([(1, url(0))], "crawl_id long, url string")
    fetched = spark.createDataFrame([(1, url(i), 500 if i == 2 else 200) for i in range(90)], "crawl_id long, url string, http_status int")
    rules = spark.createDataFrame([(1, ["/p3"])], "crawl_id long, disallow array<string>")
    got = {r["url"]: (r["depth"], r["status"]) for r in W.crawl_frontier(roots, edges, fetched, rules).collect()}
    assert got == {url(0): (0, "completed"), url(1): (1, "completed"), url(2): (1, "failed"), url(3): (2, "blocked"), url(4): (2, "completed"),
                   url(9): (3, "completed"), url(10): (3, "completed")}
    assert W.crawl_frontier(roots, edges, fetched, rules, max_pages=3).count() == 3


def test_failure_alerts_match_the_step_by_step_rule(spark):
    rng = random.Random(11)
    rows = sorted((f"q{rng.randint(0, 1)}", i, T0 + timedelta(seconds=rng.randint(0, 6000))) for i in range(200))
    batch = {(r["queue"], r["job_id"]) for r in J.failure_alerts(spark.createDataFrame(rows, "queue string, job_id long, ts timestamp")).collect()}
    expected = set()
    for q in ("q0", "q1"):
        times, last = [], None
        mine = sorted((t, j) for queue, j, t in rows if queue == q)
        for t, j in mine:
            times = [x for x, _ in mine if t - timedelta(seconds=600) < x <= t]
            if len(times) >= 5 and (last is None or t - last >= timedelta(seconds=600)):
                last = t
                expected.add((q, j))
    assert batch == expected


def test_alert_rules(spark):
    metrics = spark.createDataFrame([(1, 70, 100, 8.0, 4.0, 0)], "project_id int, current_mentions int, previous_mentions int, current_rank double, previous_rank double, new_citations int")
    rules = spark.createDataFrame(
        [(1, 1, "visibility_drop", None, None, None, True), (2, 1, "new_citation", None, None, None, True), (3, 1, "competitor_gain", 5.0, None, None, True),
         (4, 1, "visibility_drop", None, 60, T0 - timedelta(minutes=59), True), (5, 1, "what", None, None, None, True), (6, 1, "visibility_drop", None, None, None, False)],
        "rule_id int, project_id int, type string, threshold double, cooldown_minutes int, last_fired_at timestamp, enabled boolean")
    got = {r["rule_id"]: r["outcome"] for r in J.evaluate_alerts(rules, metrics, T0).collect()}
    assert got == {1: "fired", 2: "quiet", 3: "quiet", 4: "cooled_down", 5: "quiet"}


def test_templates_fall_back_and_report_open_fields(spark):
    templates = spark.createDataFrame([("en", "k", "Hi {{name}} from {{ city }}")], "locale string, template_key string, content string")
    requests = spark.createDataFrame([(1, "de", "k", "$1")], "request_id int, locale string, template_key string, name string")
    r = render_templates(requests, templates, ["name"], "en").collect()[0]
    assert (r["rendered"], r["used_fallback"], r["unresolved"]) == ("Hi $1 from {{ city }}", True, ["city"])


def test_every_sql_twin_has_a_query():
    catalog.load()
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 150


def test_keyed_upsert_touches_only_its_partitions(spark, tmp_path):
    from sightline.sources import sinks as S

    path = f"{tmp_path}/keyed"
    rows = [(i, f"v{i}", None if i % 3 else i) for i in range(200)]
    S.write_keyed(spark.createDataFrame(rows, "id long, v string, link long"), path, ["id"], 16)
    files = lambda: {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    table = lambda: sorted(map(tuple, spark.read.parquet(path).select("id", "v", "link").collect()))
    before = files()
    batch = spark.createDataFrame([(3, "new", 77), (4, "new", 78), (900, "added", 1)], "id long, v string, link long")
    touched = S.upsert_keyed(path, batch, ["id"], ("link",), 16)
    after = files()
    untouched = {f for f in before if int(f.split("key_part=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 3 and untouched and untouched <= after
    want = sorted([r for r in rows if r[0] not in (3, 4)] + [(3, "new", 3), (4, "new", 78), (900, "added", 1)])
    assert table() == want
    S.upsert_keyed(path, batch, ["id"], ("link",), 16)  # a replay
    assert table() == want
    assert S.upsert_keyed(path, batch.limit(0), ["id"], ("link",), 16) == []


def test_days_prune_answers_through_the_join(spark, tmp_path):
    from sightline.sources.readers import answers_of_days

    answers = spark.range(400).selectExpr("id AS snapshot_id", "id % 3 AS project_id", "date_add(DATE'2024-01-01', CAST(id % 40 AS INT)) AS day", "repeat('x', 50) AS text")
    answers.write.partitionBy("day").parquet(f"{tmp_path}/answers")
    days = spark.range(40).selectExpr("id % 3 AS project_id", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS day", "id AS n")
    days.write.parquet(f"{tmp_path}/days")
    wanted = spark.read.parquet(f"{tmp_path}/days").filter("n IN (5, 6)")
    found = answers_of_days(spark.read.parquet(f"{tmp_path}/answers"), wanted)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.snapshot_id % 40 for r in found.collect()} <= {5, 6}


def test_sitemap_indexes_are_followed_once(spark):
    from sightline.operators.crawl import internal_links, sitemap_seeds

    loc = lambda *urls: "".join(f"<url><loc> {u} </loc></url>" for u in urls)
    index = "".join(f"<sitemap><loc>s{n}</loc></sitemap>" for n in range(5))
    files = [(1, "root", index + loc("p0")), (1, "s0", loc("p1", "p2", "p1")), (1, "s1", "<sitemap><loc>s4</loc></sitemap>"), (1, "s3", loc("p9")), (1, "s4", loc("p8")), (2, "root", None), (2, "s0", loc("q"))]
    df = spark.createDataFrame(files, "crawl_id long, url string, content string")
    assert sorted(map(tuple, sitemap_seeds(df, df.filter("url = 'root'")).collect())) == [(1, "p0"), (1, "p1"), (1, "p2")]
    pages = [(1, "https://a.example/x/y", '<a href="z">1</a><a href="//b.example/">2</a><a href="HTTPS://a.example/q#f">3</a><a href="mailto:m">4</a>'), (1, "no url", '<a href="z">1</a>')]
    links = internal_links(spark.createDataFrame(pages, "crawl_id long, url string, html string"), ["crawl_id"])
    assert sorted(r.link for r in links.collect()) == ["https://a.example/q", "https://a.example/x/z"]


def test_keywords_in_several_blocks(spark):
    from sightline.operators.matching import keyword_hits

    texts = [(i, t) for i, t in enumerate(["The Thing and THAT", "", None, "çava über", "a" * 50_000 + "needle"])]
    words = ["th", "that", "über", "needle", "", None, "aaaa", "nope"]
    df = spark.createDataFrame(texts, "item long, text string")
    keywords = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "brand_id long, keyword string")
    want = sorted((i, n) for i, t in texts for n, w in enumerate(words) if t and w and w in t.lower())
    for block in (1, 3, 100):
        assert sorted((r["item"], r.brand_id) for r in keyword_hits(df, keywords, "item", block=block).collect()) == want
    assert keyword_hits(df, keywords.limit(0), "item").collect() == []


def test_each_citation_but_every_fourth_is_mapped(spark):
    t = TestTables(spark, "/root/testdata/sf0.001")
    mapped, citations = t.mappings().select("citation_id"), t.citations().select("citation_id")
    assert mapped.count() == citations.filter("citation_id % 4 <> 3").count() == mapped.distinct().count()
    assert 0 < t.earlier_mappings().join(mapped, "citation_id").count() < mapped.count()


def test_a_sitemap_is_searched_once(spark):
    row = lambda *x: spark.createDataFrame([("".join(x),)], "x string").repartition(1).select(W.sitemap_urls(C("x")).alias("s")).first()["s"]
    assert tuple(row("<sitemap><loc>a</loc></sitemap>", "<url><loc> b </loc></url>" * 2, "<url><loc>a</loc></url>")) == (["b", "b"], ["a"])
    assert tuple(row("<sitemap><loc>a</loc></sitemap><sitemap> <loc>b</loc></sitemap>")) == ([], ["a", "b"])
    started = time.monotonic()
    assert len(row("<urlset>", *[f"<url><loc>https://a.example/p{i}</loc></url>" for i in range(20_000)], "</urlset>")["urls"]) == 20_000
    assert time.monotonic() - started < 30  # a search of the whole text for each URL takes minutes


def test_batches_for_python_are_bounded_by_bytes(spark):
    rows = F.pandas_udf(lambda x: x.map(lambda _: len(x)), "long")
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("t"))
    assert texts.select(rows("t").alias("n")).agg(F.max("n")).first()[0] < 1000
