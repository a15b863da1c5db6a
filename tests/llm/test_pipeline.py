import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    syllables = {"aa": "ka lo mi ta nu pe".split(), "bb": "sch ung ein ver ich heit".split()}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    docs = [(i, text(lang := rng.choice(["aa", "bb"]), rng.randrange(30, 120)), lang) for i in range(120)]
    item = text("aa", 25)
    docs += [(200 + i, docs[i][1] + "\nthe shared line\n" + text(docs[i][2], 2), docs[i][2]) for i in range(15)]  # near copies
    docs += [(400 + i, docs[7][1], docs[7][2]) for i in range(12)]  # exact copies: the first stays
    docs += [(300, docs[3][1], docs[3][2]), (301, text("aa", 20) + " " + item + " " + text("aa", 9), "aa"), (302, "123 456", "bb"), (303, "", None), (304, None, "aa"), (305, "Ω" * 50, None)]
    docs += [(None, text("bb", 40), "bb")]
    path = tmp_path_factory.mktemp("tables")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in docs], columns).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def test_stages_keep_columns_and_effects(spark, folder):
    path, source = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, path), name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    ids = {i for i, *_ in source}
    assert set(kept["language"]) == ids - {302, 303, 304, 305}
    assert set(kept["lines"]) == set(kept["language"]) - set(range(400, 412))
    assert [i for i, t in kept["lines"].items() if "the shared line" in t] == [200]
    assert kept["lines"][5] == dict((i, t) for i, t, _ in source)[5]
    gone = {i for i in kept["lines"] if i not in kept["near_duplicates"]}
    assert {300} <= gone <= {300, *range(200, 215)} and len(gone) > 10
    assert set(kept["benchmark"]) == set(kept["near_duplicates"]) - {301}
    assert kept["pieces"] == kept["benchmark"]
    assert docs.filter(F.size("ids") != F.col("n_pieces")).count() == 0


def test_run_equals_brute_force(spark, folder):
    path, source = folder
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, path).collect()}
    counts = {}
    for i, t, _ in source:
        for line in set((t or "").split("\n")):
            counts.setdefault(line.strip().lower(), set()).add(i)
    rest, first = {}, {}
    for i, t, _ in sorted(source, key=lambda d: (d[0] is not None, d[0])):
        if i in (302, 303, 304, 305):
            continue
        for n, x in enumerate(t.split("\n")):
            first.setdefault(x.strip().lower(), (i, n))
        rest[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if not (x.strip() and len(counts[x.strip().lower()]) >= 10 and first[x.strip().lower()] != (i, n)))
    rest = {i: t for i, t in rest.items() if t.strip()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rest.items() for w in [t.lower().split()]}
    named = sorted(i for i in sets if i is not None)
    label = {i: i for i in named}
    for _ in range(3):
        for a in named:
            for b in named:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == {i: t for i, t in rest.items() if i != 301 and (i is None or label[i] == i)}


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_and_repeated_rows(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id < 3 OR doc_id = 7")
    extra = {"ids": F.lit("i"), "n_pieces": F.lit("n"), "n_lines": F.lit("l"), "n_dropped": F.lit("d"), "kept_text": F.lit("k"), "leak": F.lit("x"), "kept": F.lit("y")}
    docs.union(docs).withColumns(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == [0, 0, 1, 1, 2, 2, 7, 7]  # rows of one id are one document
    assert all([r[c] for c in extra] == list("inldkxy") and len(r.ids_) == r.n_pieces_ for r in rows)


def test_long_text_with_many_passages_goes(spark, tmp_path):
    item = [f"w{i}" for i in range(26)]
    words = [f"x{i}" for i in range(200_000)]
    clean = " ".join(words)
    for at in range(100, 12_900, 128):
        words[at : at + 26] = item
    docs = spark.createDataFrame([(1, " ".join(words)), (2, clean), (None, "a b"), (None, " ".join(item))], "doc_id long, text string")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()] == [2]
