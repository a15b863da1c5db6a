"""Reading tables, writing intermediate tables to the shared folder, and text hashing shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import checkpoint_dir

#: bytes of text that one vectorised step works on; a longer text is a step of its own
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sightline-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder. Cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: 64-bit words of a bit table
TABLE_WORDS = 1 << 16


def _places(h: Column, n_words: int) -> list[tuple[Column, Column]]:
    """Two (word, bit) places of a hash in a bit table."""
    part = lambda by, mask: F.shiftrightunsigned(h, by).bitwiseAND(F.lit(mask)).cast("int")
    return [(part(by, n_words - 1), part(by + 40, 63)) for by in (0, 18)]


def bit_table(hashes: DataFrame, n_words: int = TABLE_WORDS) -> Column:
    """A Bloom filter of the column ``h``, ``n_words`` (a power of two) 64-bit words whatever the number of rows, as a scalar
    subquery. Null hashes are left out."""
    places = hashes.filter("h IS NOT NULL").select(F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _places(F.col("h"), n_words)])).alias("p"))
    words = places.groupBy(F.col("p.word").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))
    every = hashes.sparkSession.range(n_words).select(F.col("id").cast("int").alias("word"))
    dense = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits")).scalar()


def might_contain(table: Column, h: Column, n_words: int = TABLE_WORDS) -> Column:
    (w0, b0), (w1, b1) = _places(h, n_words)
    return (F.getbit(F.get(table, w0), b0) == 1) & (F.getbit(F.get(table, w1), b1) == 1)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, CHUNK_BYTES + (1 << 16)), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every word of the texts, A-Z lower-cased, split at ASCII white space."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(raw))[0][: len(raw)], _powers(len(raw))[1]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    firsts = np.cumsum(lengths)  # the separator after each text
    return np.searchsorted(firsts, starts, "left"), mix((total[ends] - total[starts]) * inverse[starts])


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word shingles of each text, sorted by both. A text of fewer words has its
    whole sequence as one shingle; a text without words has none."""
    doc, words = word_hashes(texts)
    if not len(doc):
        return doc, words
    weights = mix(np.arange(1, size + 2, dtype=np.uint64))
    n = len(doc)
    parts_d, parts_h = [], []
    if n >= size:
        whole = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        h = np.zeros(len(whole), np.uint64)
        for j in range(size):
            h += words[whole + j] * weights[j]
        parts_d.append(doc[whole])
        parts_h.append(mix(h))
    ids, first, count = np.unique(doc, return_index=True, return_counts=True)
    short = count < size
    if short.any():
        ids, first, count = ids[short], first[short], count[short]
        h = count.astype(np.uint64) * weights[size]
        for j in range(size - 1):
            has = count > j
            h[has] += words[first[has] + j] * weights[j]
        parts_d.append(ids)
        parts_h.append(mix(h))
    d, h = np.concatenate(parts_d), np.concatenate(parts_h)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[fresh], h[fresh]
