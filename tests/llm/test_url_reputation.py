from pyspark.sql import functions as F

from sightline.llm import url_reputation as U

URLS = [
    "http://A.Example.NET/en/x?q#f", "https://example.net/de/", "http://notexample.net/en/", "http://x.org/fr/1", "http://x.org/fr", "http://example.com/de/1",
    "http://sub.example.com/de/", "http://example.com", "http://example.com?x=/de/", "ftp://h://y/z", "no scheme", "", None, "://", "://HÖST.De/ä", "http://a.co.uk/p", "http://net/", "http://net",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, bound int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, labels).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/de/", "net/", "block"), 2: ("notexample.net", "/en/", "net/", "block"),
        3: ("x.org", "/fr/1", "org/fr/", "allow"), 4: ("x.org", "/fr", None, "allow"), 5: ("example.com", "/de/1", "example.com/de/", "block"),
        6: ("sub.example.com", "/de/", "example.com/de/", "block"), 7: ("example.com", "", None, "allow"), 8: ("example.com", "", None, "allow"),
        9: ("h:", "//y/z", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("", "", None, "allow"), 13: ("", "", None, "allow"),
        14: ("hÖst.de", "/ä", None, "allow"), 15: ("a.co.uk", "/p", None, "allow"), 16: ("net", "/", "net/", "block"), 17: ("net", "", None, "allow"),
    }


def test_levels(spark):
    df = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "co.uk", "x.com", "com", "", "a.b.c.de")], "host string")
    got = {r.host: (r.domain, r.suffix) for r in U.with_levels(df).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.com": ("x.com", "com"), "com": ("com", "com"), "": ("", ""), "a.b.c.de": ("c.de", "de")}


def test_bad_hosts_are_blocked_and_shrunk(spark):
    pages = [(i, f"http://{h}/p{i}") for i, h in enumerate(["bad.spam.io"] * 40 + ["good.site.io"] * 40 + ["new.spam.io", "new.site.io", "other.info"])]
    labels = [(i, int(i >= 40), 0) for i in range(80)] + [(79, None, None), (500, 0, 1), (None, 0, 1)]
    got = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    by = {r.host: r for r in got.withColumn("n", F.count(F.lit(1)).over(__import__("pyspark").sql.Window.partitionBy("host"))).collect()}
    assert by["bad.spam.io"].verdict == "block" and by["good.site.io"].verdict == "allow" and by["good.site.io"].labelled == 40
    assert by["good.site.io"].bad_rate < by["new.site.io"].bad_rate < by["new.spam.io"].bad_rate < by["bad.spam.io"].bad_rate
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
