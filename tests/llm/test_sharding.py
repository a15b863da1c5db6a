import zlib

import pandas as pd

from sightline.llm import sharding


def test_even_whole_and_gapless(spark):
    rows = [(i, "w " * (i * 37 % 400)) for i in range(3000)] + [(10_000 + i, "a text that many rows share " * 8) for i in range(1200)]
    rows += [(20_000 + i, "kept together " * 20) for i in range(60)] + [(i, None) for i in (None, 1, 1)] + [(5, ""), (6, ""), (7, "é" * 3000)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, shard int, size string").repartition(3)
    got = sharding.pack(docs, 8).toPandas()
    assert len(got) == len(rows)
    assert sorted(got["size"]) == sorted(8 + len((t or "").encode()) for _, t in rows)
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    shards = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "size"), low=("slot", "min"), high=("slot", "max"), slots=("slot", "nunique"))
    assert len(shards) == 8 and (shards.low == 0).all() and (shards.high == shards.n - 1).all() and (shards.slots == shards.n).all()
    assert shards.b.max() < 1.03 * shards.b.mean() and shards.b.min() > 0.97 * shards.b.mean()
    assert got[(got.doc_id >= 20_000) & (got.doc_id < 21_000)].shard.nunique() == 1
    again = sharding.pack(docs, 8).toPandas()
    key = ["doc_id", "size", "shard", "slot"]
    pd.testing.assert_frame_equal(*[x[key].sort_values(key).reset_index(drop=True) for x in (got, again)])


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.size, r.slot) for r in sharding.pack(docs).collect()] == [(1, 9, 0)]
    assert sharding.pack(docs.limit(0)).collect() == []


def test_same_packing_for_any_order_of_units():
    units = pd.DataFrame([(-9, k, 500, 40, 7) for k in range(64)] + [(k, 0, 100 + k % 3, 9, 1 + k % 2) for k in range(400)], columns=["unit", "part", "bytes", "tokens", "rows"])
    key = ["unit", "part"]
    first = sharding._pack(units, 8).sort_values(key).reset_index(drop=True)
    for seed in range(5):
        again = sharding._pack(units.sample(frac=1, random_state=seed), 8).sort_values(key).reset_index(drop=True)
        pd.testing.assert_frame_equal(first, again)


def test_long_text_and_clashing_columns(spark):
    rows = [(1, "word " * 400_000, "t"), (2, "b", "u"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = {r.doc_id: (r.size, r.tokens) for r in sharding.pack(docs, 2).collect()}
    assert got == {1: (2_000_008, 400_000), 2: (9, 1), 3: (8, 0)}
