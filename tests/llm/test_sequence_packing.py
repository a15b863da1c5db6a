import functools
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import sequence_packing as p
from sightline.llm.queries import QUERIES

COLUMNS = "doc_id long, text string"


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(p.vocabulary_path())
    own.encode_special_tokens = True
    return own


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, capacity):
    """Each id of each document once, sequences gapless and full but for powers of two."""
    left = {}
    for i, t in docs:
        left.setdefault(i, []).append(ids_of(t))
    sequences, parts = {}, {}
    for r in rows:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert len(got) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, got))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    for (i, n), own in parts.items():  # rows that repeat give every piece as often
        got = Counter((start + k, x) for start, ids in own for k, x in enumerate(ids))
        assert got == Counter(x for text in left[i] if len(text) == n for x in enumerate(text))
    assert sum(r.length for r in rows) == sum(len(x) for own in left.values() for x in own)


@pytest.mark.parametrize("capacity", [8, 64, 1024])
def test_packs_every_id_once(spark, capacity):
    rng = random.Random(capacity)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 9)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(200 + i, "same text " * 12) for i in range(90)]  # a hot length
    docs += [(400, None), (401, ""), (402, " "), (None, "no id"), (403, "中文 <|endoftext|> 🙂   x"), (404, "long " * 9000), (405, "x" * 30_000), (3, docs[3][1])]
    df = spark.createDataFrame(docs, COLUMNS).repartition(4).withColumns({"ids": F.lit(1), "task": F.lit(2), "length": F.lit(3), "rank": F.lit(4)})
    rows = p.packed(df, capacity=capacity).collect()
    check(rows, docs, capacity)
    cuts = len(rows) - p.pieces(df, capacity=capacity).count()
    assert 0 <= cuts <= len({r.sequence_id for r in rows}) // 4 + 10


def test_no_rows(spark):
    assert p.packed(spark.createDataFrame([], COLUMNS)).collect() == []


def test_fill_is_closest():
    rng = random.Random(4)
    for _ in range(300):
        room = rng.randrange(1, 40)
        left = {rng.randrange(1, 25): rng.randrange(0, 4) for _ in range(rng.randrange(1, 6))}
        every = [sum(x * n for x, n in zip(left, ns, strict=True)) for ns in itertools.product(*[range(n + 1) for n in left.values()])]
        got = p.fill(left, room)
        assert all(n <= left[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == max(s for s in every if s <= room)


@pytest.mark.parametrize("counts", [{}, {5: 1}, {1024: 7}, {600: 100_001}, {1023: 10**9 + 1, 2: 5}, {700: 3, 1: 2}, {x: x * 7919 % 1000 for x in range(1, 1024)}, {x: 10**8 + x for x in range(1, 1025)}])
def test_plan_places_each_rank_once(counts):
    steps = p.plan(counts)
    assert len(steps) < 20_000
    for length, _, each, _, _, cut, _ in steps.tolist():
        assert each > 0 and cut < length
    total = sum(x * n for x, n in counts.items())
    if total < 10**7:
        length = np.repeat(np.array(list(counts), np.int64), list(counts.values()))
        rank = np.concatenate([np.arange(n) for n in counts.values()]) if counts else np.zeros(0, np.int64)
        ends, begins = {}, []
        for _, _, size, sequence, offset in p.place(steps, length, rank):
            begins += list(zip(sequence.tolist(), offset.tolist(), size.tolist(), strict=True))
        for sequence, offset, size in sorted(begins):
            assert ends.get(sequence, 0) == offset
            ends[sequence] = offset + size
        short = [e for e in ends.values() if e != 1024]
        assert sum(ends.values()) == total and all(e & (e - 1) == 0 for e in short) and len(short) <= 10


def test_both_libraries_agree():
    chars = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250))]
    rng = random.Random(1)
    encode, width = p.encoder(p.vocabulary_path())
    assert width == 2
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 30)))
        assert encode(text).tolist() == ids_of(text)[:-1]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    texts = {i: ids_of(t) for i, t in docs}
    rows = QUERIES["op12_minimum_bin_slack"](spark, path).collect()
    for r in rows:
        own = np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(texts[r.doc_id]) and len(own) == r.length
    assert sum(r.length for r in rows) == sum(map(len, texts.values()))
