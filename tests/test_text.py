import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import dates, numbers, urls
from sightline.functions.json_text import canonical_json, mask_keys
from sightline.functions.similarity import jaro_winkler
from sightline.functions.text import MASK, mask_urls
from sightline.operators.citations import extract_citations, reddit_parts
from sightline.operators.matching import keyword_hits, match_pages
from sightline.operators.mentions import brand_config, extract_mentions
from sightline.operators.rankings import add_rankings, ranking_rows


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expr.alias("x")).collect()[0]["x"]


def jaro_winkler_by_hand(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, free, left = max(0, max(len(a), len(b)) // 2 - 1), [True] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if free[j] and b[j] == ch:
                free[j] = False
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    m, t = len(left), sum(x != y for x, y in zip(left, right)) / 2
    base = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return base + p * 0.1 * (1 - base)


def test_jaro_winkler_against_the_plain_algorithm(spark):
    rng = random.Random(7)
    pairs = [("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), ("a", "a"), ("für", "fur")]
    pairs += [tuple("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect():
        assert r["s"] == pytest.approx(jaro_winkler_by_hand(r["a"], r["b"]), abs=1e-9), (r["a"], r["b"])


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("HTTPS://WWW.Ex.com:443/?utm_source=x#f", "https://www.ex.com"),
        ("http://ex.com/a/?b=1&fbclid=2&c", "http://ex.com/a/?b=1&c="),
        ("https://ex.com/für", "https://ex.com/f%C3%BCr"),
        ("mailto:a@b.c", None), ("no url", None),
    ],
)
def test_canonical_urls(spark, raw, expected):
    assert one(spark, urls.canonical(F.col("u")), u=raw) == expected


@pytest.mark.parametrize(
    ("ref", "expected"),
    [
        ("/x", "https://a.example/x"), ("y?q=1#f", "https://a.example/d/y?q=1"), ("../z", "https://a.example/z"), ("//b.example/p", "https://b.example/p"),
        ("", "https://a.example/d/e?k=1"), ("?n=2", "https://a.example/d/e?n=2"), ("javascript:void(0)", None), ("http://c.example", "http://c.example/"),
    ],
)
def test_resolve(spark, ref, expected):
    got = one(spark, urls.resolve(F.col("r"), F.lit("https://a.example/d/e?k=1")), r=ref)
    assert (got if expected is None or "b.example" not in expected else got) == expected


def test_normalize_leaves_other_text_alone(spark):
    assert one(spark, urls.normalize(F.col("u")), u="not a url") == "not a url"
    assert one(spark, urls.normalize(F.col("u")), u="https://www.ex.com/a/?ref=1&b=2#x") == "https://ex.com/a?b=2"


def test_mask_keeps_offsets(spark):
    text = "see https://x.example/that that)https://y.example"
    masked = one(spark, mask_urls(F.col("t")), t=text)
    assert len(masked) == len(text) and masked.replace(MASK, "") == "see  that)"


def test_rounding_is_half_up(spark):
    got = spark.createDataFrame([(2.5,), (-2.5,), (0.5,)], "x double").select(numbers.round_half_up(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in got] == [3, -2, 1]


def test_dates(spark):
    for text in ("2024-01-05", "Jan 5, 2024", "5 January 2024", "2024-01-05T00:00:00Z", "01/05/2024"):
        assert str(one(spark, dates.parse_date(F.col("t")), t=text))[:10] == "2024-01-05", text
    for text in ("soon", "1905-01-01", "2200-01-01"):
        assert one(spark, dates.parse_date(F.col("t")), t=text) is None


def test_json_helpers(spark):
    assert one(spark, canonical_json(F.col("j")), j='{ "a" : [1, 2] }') == '{"a":[1,2]}'
    assert one(spark, mask_keys(F.col("j"), ("email",)), j='{"x":{"Email":"a\\"b"},"n":1}') == '{"x":{"Email":"[REDACTED]"},"n":1}'
    mask = mask_keys(F.col("j"), ("name", "ip"))
    assert one(spark, mask, j='{"name":{"first":{"given":"Ada","family":"L"},"x":1}, "k": [1.5]}') == '{"name":"[REDACTED]","k":[1.5]}'
    assert one(spark, mask, j='[{"a":[{"IP":[{"b":"1"}],"c":"\\"ip\\": 2"}]}]') == '[{"a":[{"IP":"[REDACTED]","c":"\\"ip\\": 2"}]}]'
    assert one(spark, mask, j='{"name": "Ada') == '"[REDACTED]"' and one(spark, mask, j='[' * 100_000) == '"[REDACTED]"'


# --- mentions, rankings, citations ---------------------------------------------------------------------


def mine(spark, text, names=("Acme Cloud",), domains=("acme.example",), competitors=("Globex", "Initech")):
    answers = spark.createDataFrame([(1, 1, "chatgpt", text)], "snapshot_id long, project_id long, ai_engine string, text string")
    cfg = brand_config(
        spark.createDataFrame([(1, names[0], n) for n in names], "project_id long, brand string, name string"),
        spark.createDataFrame([(1, d) for d in domains], "project_id long, domain string"),
        spark.createDataFrame([(1, c) for c in competitors], "project_id long, keyword string"))
    return answers, cfg


def test_mentions_exact_fuzzy_and_domain(spark):
    text = "We recommend ACME Cloud for most teams of any size. " + "x " * 20 + "Acme Clodu is a typo of it. " + "y " * 20 + "See https://www.acme.example/acme for more."
    got = extract_mentions(*mine(spark, text)).orderBy("position").collect()
    assert [(r["match_type"], r["matched_text"]) for r in got] == [
        ("exact", "ACME Cloud"), ("fuzzy", "Acme Clodu"), ("contextual", "https://www.acme.example/acme")]
    assert got[0]["mention_type"] == "recommendation" and got[0]["relative_position"] == "top"
    assert [text[r["position"]:][: len(r["matched_text"])] for r in got] == [r["matched_text"] for r in got]


def test_near_matches_collapse_to_the_best(spark):
    got = extract_mentions(*mine(spark, "Acm Acme", names=("Acme",))).collect()
    assert [(r["matched_text"], r["position"]) for r in got] == [("Acme", 4)]


def test_short_names_need_their_case_and_word_bounds(spark):
    got = extract_mentions(*mine(spark, "hp HP HPE php", names=("HP",), domains=())).collect()
    assert [r["position"] for r in got] == [3]


def test_every_mention_is_kept(spark):
    text = " ".join(["Acme " + "z" * 30] * 60)
    assert extract_mentions(*mine(spark, text, names=("Acme",))).count() == 60


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1. Globex\n2. **Acme Cloud**\n3) Initech", [("Globex", 1, "list"), ("Acme Cloud", 2, "list"), ("Initech", 3, "list")]),
        ("- a\n- Acme Cloud\n- Globex", [("Acme Cloud", 2, "list"), ("Globex", 3, "list")]),
        ("1. Globex\n2. Acme Cloud", [("Globex", 1, "mention-order"), ("Acme Cloud", 2, "mention-order")]),
        ("Initech beats Acme Cloud", [("Initech", 1, "mention-order"), ("Acme Cloud", 2, "mention-order")]),
        ("Only Globex here", []),
    ],
)
def test_rankings(spark, text, expected):
    answers, cfg = mine(spark, text)
    rows = ranking_rows(add_rankings(answers.join(cfg, "project_id"))).orderBy("rank_position").collect()
    assert [(r["entity"], r["rank_position"], r["source"]) for r in rows] == expected


def test_citations_of_all_forms(spark):
    text = "[A](https://a.example/x) <https://b.example/> [1]: https://c.example/y. and https://d.example/z?utm_x=1! (https://e.example)"
    df = spark.createDataFrame([(1, text)], "snapshot_id long, text string")
    got = extract_citations(df).orderBy("position").collect()
    assert [r["url"] for r in got] == ["https://a.example/x", "https://b.example", "https://c.example/y", "https://d.example/z"]
    assert [r["position"] for r in got][:2] == [0, 25]


def test_reddit_parts(spark):
    p = one(spark, reddit_parts(F.col("u")), u="https://old.reddit.com/r/Foo/comments/abc/title/def?x=1")
    assert (p["subreddit"], p["post_id"], p["comment_id"]) == ("foo", "abc", "def")


# --- matching against brute force -------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_match_cascade_equals_brute_force(spark):
    rng = random.Random(3)
    path = lambda: "/" + "".join(rng.choice("abc/") for _ in range(rng.randint(0, 7)))
    pages = [(i, f"https://www.hot.example{path()}", i) for i in range(120)]
    wanted = [(f"https://hot.example{path()}",) for _ in range(120)] + [("https://cold.example/a",), (pages[5][1],)]
    got = {r["url"]: (r["match_type"], r["client_page_id"], r["confidence"]) for r in match_pages(
        spark.createDataFrame(wanted, "url string"), spark.createDataFrame(pages, "client_page_id long, url string, candidate_order long")).collect()}

    def parts(u):
        host, _, p = u.removeprefix("https://").partition("/")
        p = "/" + p
        return host.removeprefix("www."), (p[:-1] if p.endswith("/") else p) or "/"

    for (u,) in set(wanted):
        best = ("unmatched", None, 0)
        same = [(i, *parts(p)) for i, p, _ in pages if parts(p)[0] == parts(u)[0]]
        near = sorted((edits(p, parts(u)[1]), i) for i, _, p in same if edits(p, parts(u)[1]) <= 2)
        exact = [i for i, p, _ in pages if p == u]
        equal = [i for i, _, p in same if p == parts(u)[1]]
        if exact:
            best = ("exact", exact[0], 100)
        elif equal:
            best = ("path", equal[0], 80)
        elif near:
            best = ("fuzzy", near[0][1], 70 - 10 * near[0][0])
        assert got[u] == best, u


def test_keyword_hits(spark):
    texts = spark.createDataFrame([(1, "The Quick brown fox"), (2, "ox"), (3, ""), (4, "brownfox"), (5, None)], "k long, text string")
    words = spark.createDataFrame([("fox",), ("ox",), ("q",), ("brown f",)], "keyword string")
    pairs = sorted((r["k"], r["keyword"]) for r in keyword_hits(texts, words, "k").collect())
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(1, "fox"), (1, "ox"), (1, "q"), (1, "brown f"), (2, "ox"), (4, "fox"), (4, "ox")}
