import random
import re

import pytest

from sightline.llm import near_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(x), label[i], label[i] == i) for i, x in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = text(120), text(60)
    docs = [" ".join(edited(rng, base, rng.randrange(0, 6))) for _ in range(70)]  # a large near group around one text
    docs += [" ".join(text(rng.randrange(5, 40)) + passage + text(rng.randrange(0, 25))) for _ in range(60)]  # one passage in unlike texts
    docs += [" ".join(passage + text(k % 7)) for k in range(40)]
    chain = text(100)
    for _ in range(12):  # each is near the one before only
        docs.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    docs += [" ".join(text(rng.randrange(1, 9))) for _ in range(20)]
    docs += ["Same\tWords here", "same words  HERE", "four words are here", None, "", " \n\t ", "ÄB cd", "äb cd", "x " * 3000, "x " * 5]
    return list(enumerate(docs)) + [(1000, docs[0]), (1001, docs[0])]


@pytest.mark.parametrize("hot", [8, 32])
def test_classes_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rows = corpus()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0, "a") for i, t in rows], "doc_id long, text string, label int, v string").repartition(3)
    frequent = near_dedup.frequent_shingles(docs, hot)
    assert any(frequent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_force(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, 2, 0, True), (3, 2, 3, True), (3, 2, 3, True), (5, 0, 5, True), (7, 2, 3, False)]
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_sets_of_one_id_are_bounded_apart(spark):
    # id 5 has a set of 10 and one of 100, which holds more values together with the 10 of id 9
    short = [(v, 5, 10, 0) for v in range(2)]
    long = [(v, 5, 100, 0) for v in range(2, 40)]
    rows = short + long + [(v, 9, 10, 0) for v in range(40)]
    for order in (rows, rows[::-1]):
        postings = spark.createDataFrame(order, "v long, rep long, n int, h int")
        assert {tuple(r) for r in near_dedup._lists_to_pairs(postings).collect()} == {(5, 9)}


def test_components_of_random_links(spark):
    rng = random.Random(5)
    nodes = 300
    links = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 1999)] * 2
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in parent if any(x in link and link[0] != link[1] for link in links)}
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.label for r in near_dedup.components(df).collect()} == want
    first = near_dedup.components(df.limit(90))
    assert {r.node: r.label for r in near_dedup.components(df.subtract(df.limit(90)), first).collect()} == want
    assert near_dedup.components(df.limit(0)).collect() == []
