"""The deletion-neighbourhood index against a comparison of all words with all names."""

import random

from pyspark.sql import functions as F

from sightline.functions.similarity import jaro_winkler
from sightline.operators.near_names import group_hashes, name_hashes, near_names, neighbourhood

TEXTS = "snapshot_id long, project_id long, text string"
NAMES = "project_id long, name string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def changed(rng, word, k):
    letters = list(word)
    for _ in range(k):
        at = rng.randrange(len(letters) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            letters.insert(at, rng.choice("abé😀"))
        elif letters[at:]:
            letters[at : at + 1] = [] if kind == 1 else [rng.choice("abé😀")]
    return "".join(letters)


def test_strings_within_k_edits_share_a_hash(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abcdé😀") for _ in range(rng.randrange(4, 16)))
        k = rng.randrange(1, 4)
        b = changed(rng, a, k)
        if b:
            rows.append((a, b, k))
    df = spark.createDataFrame(rows, "a string, b string, k int")
    apart = df.filter(~F.arrays_overlap(neighbourhood(F.col("a"), F.col("k")), neighbourhood(F.col("b"), F.col("k"))))
    assert apart.count() == 0
    assert df.select(F.max(F.size(neighbourhood(F.col("a"), F.lit(3)))).alias("n")).first()["n"] <= 93


def test_equals_all_pairs(spark):
    rng = random.Random(9)
    names = [(p, n) for p in (1, 2) for n in ("abc", "Abcd", "acme", "bananas", "Acme Cloud", "blue sky labs", "éclair😀", "long winded name")]
    names += [(1, "acme"), (1, None), (1, ""), (1, "ab"), (3, "unused"), (None, "acme")]
    texts = []
    for i in range(60):
        parts = [changed(rng, rng.choice(names[:16])[1], rng.randrange(0, 5)) or "x" for _ in range(6)]
        texts.append((i, rng.choice([1, 2, 4]), " ".join(parts)))
    texts += [(90, 1, None), (91, 1, ""), (92, 1, "acmee"), (93, 1, "acmee " * 300), (94, 1, "https://acmee.example acmee"), (95, None, "acmee"), (92, 1, "acmee")]
    want, pairs = [], []
    for key, project, text in texts:
        words = [w for w in (text or "").split() if not w.startswith("https://")]
        for owner, name in set(names):
            if name is None or owner != project or project is None or len(name) <= 2:
                continue
            low, n = name.lower(), len(name.split())
            cap = 1 if len(low) <= 4 else 2 if len(low) <= 7 else 3
            for size in {1, n} if len(low) > 4 else {1}:
                for i in range(len(words) - size + 1):
                    group = " ".join(words[i : i + size])
                    near = group.lower() != low and edits(group.lower(), low) <= cap
                    if near and (size > 1 or abs(len(group) - len(low)) <= 2):
                        pairs.append((key, name, group, group.lower(), low))
    scored = spark.createDataFrame(pairs, "key long, name string, text string, a string, b string").withColumn("s", jaro_winkler(F.col("a"), F.col("b")))
    for r in scored.collect():
        if len(r.b) <= 4:
            want.append((r.key, r.name, r.text, round((1 - edits(r.a, r.b) / max(len(r.a), len(r.b))) * 0.9, 9)))
        elif r.s >= (0.88 if len(r.b) <= 7 else 0.85):
            want.append((r.key, r.name, r.text, round(r.s * 0.9, 9)))
    answers = spark.createDataFrame(texts, TEXTS).withColumn("words", F.lit("clash")).withColumn("h", F.lit(1))
    got = near_names(answers, spark.createDataFrame(names, NAMES).withColumn("low", F.lit("clash"))).collect()
    assert len(want) > 300
    assert sorted((r.snapshot_id, r.name, r.matched_text, round(r.confidence, 9)) for r in got) == sorted(want)
    by_key = {t[0]: t[2] for t in texts}
    assert all(by_key[r.snapshot_id][r.position : r.position + r.len] == r.matched_text for r in got)


def test_empty_tables(spark):
    answers = spark.createDataFrame([(1, 1, "acmee")], TEXTS)
    names = spark.createDataFrame([(1, "acme")], NAMES)
    assert near_names(answers, names).count() == 1
    assert near_names(answers.limit(0), names).collect() == near_names(answers, names.limit(0)).collect() == []


def test_names_and_groups_share_one_of_few_hashes(spark):
    rng = random.Random(15)
    rows = []
    for _ in range(1500):
        name = "".join(rng.choice("abcdé😀") for _ in range(rng.randrange(3, 18)))
        low = changed(rng, name, rng.randrange(1, 4))
        cap = 1 if len(name) <= 4 else 2 if len(name) <= 7 else 3
        if low and edits(name, low) <= cap:
            rows.append((name, low))
    df = spark.createDataFrame(rows, "name string, low string")
    assert df.filter(F.arrays_overlap(name_hashes(F.col("name")), group_hashes(F.col("low")))).count() == len(rows) > 1000
    most = df.select(F.max(F.size(group_hashes(F.concat("name", "low")))), F.max(F.size(name_hashes(F.col("name"))))).first()
    assert most[0] <= 77 and most[1] <= 37
    long = df.filter(F.length("low") > 9).select(F.max(F.size(group_hashes(F.col("low")))).alias("n")).first()["n"]
    assert long <= 40
