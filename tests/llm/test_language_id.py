import random

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import language_id

SYLLABLES = {"aa": "ka lo mi ta nu".split(), "bb": "sch ung ein ver ich".split(), "cc": "ção nho ões ava lhe".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labelled(spark, n=300):
    rng = random.Random(3)
    rows = [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(3, 80)), lang) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_edge_cases(spark):
    rows, docs = labelled(spark)
    model = language_id.fit(docs.filter(~language_id.held_out()))
    assert model.languages == ["aa", "bb", "cc"]
    odd = [(1001, None, "aa"), (1002, "", None), (1003, "123 !?", "bb"), (1004, "KALOMI kalo", None), (None, "schung", None), (1005, "kalo " * 50_000, None)]
    both = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("_language", F.lit(1)).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in language_id.identify(both, model).collect()}
    tested = [(lang, got[i]) for i, _, lang in rows if i in {r.doc_id for r in docs.filter(language_id.held_out()).collect()}]
    assert len(tested) > 40 and np.mean([lang == r.lang_pred for lang, r in tested]) > 0.98
    assert all(0 <= r.score <= 1 and r["_language"] == 1 for r in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert got[1004].lang_pred == got[1005].lang_pred == "aa" and got[None].lang_pred == "bb"


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "kalo", None), (2, None, "aa"), (None, "kalo", "aa")], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == []
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), model).collect() == []


def test_grams_of_a_batch_equal_those_of_each_text():
    texts = [x.encode() for x in ("Ab c", "", "é-é", "zZ top!", "a")]
    doc, h = language_id.grams(texts)
    for i, t in enumerate(texts):
        assert sorted(h[doc == i]) == sorted(language_id.grams([t])[1])


def test_more_than_64_languages(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        own = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(6)]
        rows += [(k * 10 + j, " ".join(rng.choice(own) for _ in range(20)), f"l{k:02}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    assert model.slots.shape[1] == 2 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
