import random
import re

from sightline.llm import decontamination as D


def brute_force(docs, items):
    """Every pair of positions where the tokens of a mask agree, then every window around it."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, text in docs:
        w = tokens(text)
        for item, other in items:
            v = tokens(other)
            length = min(len(v), D.WINDOW)
            for i in range(len(w)):
                for j in range(len(v)):
                    if not any(j + m[-1] < len(v) and i + m[-1] < len(w) and all(w[i + o] == v[j + o] for o in m) for m in D.MASKS):
                        continue
                    for t in range(1 - length, 1):
                        if j + t >= 0 and j + t + length <= len(v):
                            same = sum(0 <= i + t + x < len(w) and w[i + t + x] == v[j + t + x] for x in range(length))
                            if same * 10 >= length * 8:
                                out[d, item] = max(out.get((d, item), 0), same)
    return out


def test_equals_brute_force_and_tolerates_substitutions(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, text(rng.randrange(14, 40))) for k in range(6)] + [(6, text(7)), (7, text(5)), (8, text(6))]
    docs = [(i, text(60)) for i in range(10)]
    for k, item in items:
        docs.append((100 + k, text(20) + item + text(5)))
        changed = list(item)
        for at in range(3, len(changed), 7):  # one token in seven is another
            changed[at] = "other"
        docs.append((200 + k, text(9) + changed))
        docs.append((300 + k, item[len(item) // 2 :] + text(30)))
        docs.append((400 + k, item[::2] + text(10)))
    docs = [(i, " ".join(w)) for i, w in docs] + [(500, None), (501, ""), (502, "..."), (503, "w1"), (100, "w2 " * 20)]
    docs += [(504, ", ".join(w.upper() for w in items[0][1]) + "!")]
    items = [(k, " ".join(w)) for k, w in items] + [(9, None), (10, ""), (0, " ".join(items[0][1]))]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, h int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, w int")
    got = {(r.doc_id, r.item_id): r.matched for r in D.overlaps(d, b).collect()}
    assert got == brute_force(docs, items)
    assert all((100 + k, k) in got and (200 + k, k) in got for k in range(6)) and (504, 0) in got
    assert not any(i < 100 or i >= 400 and i != 504 for i, _ in got)


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(None, text), (1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(None, text)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.matched, r.first_token) for r in D.overlaps(d, b).collect()] == [(None, None, 13, 0)]
    assert D.overlaps(d.limit(0), b).collect() == D.overlaps(d, b.limit(0)).collect() == []


def test_long_text_with_many_hits(spark):
    item = [f"w{i}" for i in range(26)]
    words = [f"x{i}" for i in range(200_000)]
    starts = [*range(100, 12_900, 128), *range(20_000, 20_300, 29), len(words) - 26]  # across the edges of blocks of any size
    for at in starts:
        words[at : at + 26] = item
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[150:]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.overlaps(d, b).collect()}
    assert got == {1: (7, 13, 100, 21 * len(starts)), 2: (7, 13, 78, 21 * (len(starts) - 1))}


def test_no_token_in_the_rows_of_the_last_exchange(spark):
    text = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    plan = D.overlaps(d, b)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "doc_id" in x]
    assert dealt and not any("near" in x for x in dealt)


def test_many_items(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    items = [" ".join(rng.choices(words, k=40)) for _ in range(800)]
    path = f"{tmp_path}/items.parquet"
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(path)
    b = spark.read.parquet(path)
    d = spark.createDataFrame([(k, f"a b {items[k]} c") for k in range(0, 800, 40)] + [(-1, " ".join(rng.choices(words, k=500)))], "doc_id long, text string")
    found = D.overlaps(d, b)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()  # the seeds are 80 MB
    got = [(r.doc_id, r.item_id, r.matched, r.first_token) for r in found.collect()]
    assert sorted(x for x in got if x[0] == x[1]) == [(k, k, 13, 2) for k in range(0, 800, 40)]
    assert not [x for x in got if x[0] == -1]
