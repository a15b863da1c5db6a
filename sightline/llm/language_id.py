"""Language identification with language-bitmask n-gram filters.

Method. Letter n-grams (words with their edges) of labelled texts are counted per language. A language contains an
n-gram if it uses it at least ``share`` times as often as the language that uses it most. All languages sit in one
bit-sliced Bloom filter: a slot holds a bit for each language, and the AND of an n-gram's slots is the set of all
languages that contain it. A text's n-grams are looked up at once; the population count of each language's bit, less the
false hits expected from how full that language's slice is, decides. Ties go to the name that sorts first.

Scale. The filter has a fixed size, so it is sent to every task. It is fitted on at most about ``rows_per_language``
labelled texts of each language, chosen by a hash of their id; prediction reads every whole text once, in Arrow batches.

A null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned. The score is the
corrected share of a text's n-grams that the language contains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import chunks, fresh, mix

UNDETERMINED = "und"
SIZES = (3, 4)
SLOT_BITS, HASHES = 20, 2

_LETTERS: list[np.ndarray] = []


@dataclass
class Filter:
    """languages: by bit; slots: (2^SLOT_BITS, words of 64 languages)."""

    languages: list[str]
    slots: np.ndarray


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every letter n-gram. Case is folded; all that is no letter is a word edge."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    lower = [t.decode("utf-8", "replace").lower() for t in texts]
    codes = np.frombuffer("\0".join(["", *lower, ""]).encode("utf-32-le", "replace"), np.uint32).copy()
    codes[~_LETTERS[0][codes]] = 0
    # one edge between words: drop repeated zeros
    used = np.ones(len(codes), bool)
    used[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower)))
    place = np.flatnonzero(used)
    codes = codes[used].astype(np.uint64)
    found = []
    for size in SIZES:
        if len(codes) < size:
            continue
        n = len(codes) - size + 1
        inner = np.ones(n, bool)
        for j in range(1, size - 1):
            inner &= codes[j : j + n] != 0
        at = np.flatnonzero(inner)
        h = np.full(len(at), size, np.uint64)
        for j in range(size):
            h = h * np.uint64(0x100000001B3) + codes[at + j]
        found.append((np.searchsorted(ends, place[at + 1], "left"), mix(h)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found])


def slots_of(h: np.ndarray) -> list[np.ndarray]:
    """The slots of each hash, from separate bits of it."""
    return [((h >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(HASHES)]


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def fit(labelled: DataFrame, rows_per_language: int = 4000, share: float = 0.3, least: int = 2) -> Filter:
    """Fit the filter to (doc_id, text, lang) rows; rows with a null in any of them are left out."""
    rows = labelled.select("doc_id", "text", "lang").filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    rate = rows.groupBy("lang").agg(F.least(F.lit(1.0), rows_per_language / F.count(F.lit(1))).alias("rate"))
    # one entry for each language, as a scalar: rows are chosen in the scan, and no text moves
    rates = rate.agg(F.map_from_entries(F.collect_list(F.struct("lang", "rate"))).alias("rates")).scalar()
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(rates, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = _texts(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
            for a, b in chunks(texts):
                doc, h = grams(texts[a:b])
                for lang in set(langs[a:b]):
                    g, n = np.unique(h[(langs[a:b] == lang)[doc]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    top = counts.groupBy("gram").agg(F.max("rate").alias("top"))
    inserted = counts.filter(F.col("n") >= least).join(top, "gram").filter(F.col("rate") >= share * F.col("top"))
    slot = F.explode(F.array(*[F.shiftrightunsigned("gram", i * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int") for i in range(HASHES)]))
    found = inserted.select("lang", slot.alias("slot")).distinct().toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    slots = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    number = {lang: i for i, lang in enumerate(languages)}
    bits = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    np.bitwise_or.at(slots, (found.column("slot").to_numpy(), bits >> 6), np.uint64(1) << (bits & 63).astype(np.uint64))
    return Filter(languages, slots)


def predictor(spark, model: Filter):
    """A column function: text -> struct of lang_pred and score."""
    sent = spark.sparkContext.broadcast((model.languages, model.slots))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    known: list = []

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        languages, slots = sent.value
        if not known:
            full = [np.mean((slots[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)) for i in range(len(languages))]
            known.append([f**HASHES for f in full])
        names, scores = [], []
        texts = _texts(text)
        for a, b in chunks(texts):
            doc, h = grams(texts[a:b])
            mask = slots[slots_of(h)[0]]
            for more in slots_of(h)[1:]:
                mask = mask & slots[more]
            total = np.bincount(doc, minlength=b - a)
            best, name = np.zeros(b - a), np.full(b - a, -1)
            for i in range(len(languages)):
                hits = np.bincount(doc, (mask[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1), b - a)
                real = np.clip((hits - total * known[0][i]) / max(1 - known[0][i], 1e-9), 0, None)
                better = (total > 0) & ((name < 0) | (real > best))
                best[better], name[better] = real[better], i
            names += [languages[i] if i >= 0 else UNDETERMINED for i in name]
            scores += np.where(name >= 0, np.minimum(best / np.maximum(total, 1), 1.0), 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return predict


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept back from fitting (a quarter, by its id; null ids are neither fitted nor held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from its ``text`` alone; columns of these names are replaced."""
    own = fresh(docs, "_language")
    found = docs.withColumn(own, predictor(docs.sparkSession, model)(F.col("text").cast("string")))
    return found.withColumns({"lang_pred": F.col(own)["lang_pred"], "score": F.col(own)["score"]}).drop(own)
