"""Line deduplication: lines found in many documents go, and per-document bitmaps say which lines stay.

Method. Each line becomes (128-bit hash of its key, document, position). These rows are range-partitioned and sorted by
hash, document and position, so that a frequent line is spread over several ranges by document. Streaming through a
range, the first row of each (hash, document) counts a document; counts are added up before they are shuffled by hash.
Lines of hashes that reach the bound come back as (document, position) and are folded into one bitmap per document:
64 lines a word, only words with a dropped line are stored, so a document without one has no bitmap. No text moves
before the bitmaps are applied; texts are split once for the hashes, which are written, and once for the lines that stay.

A key is the line without the white space at both ends, A-Z lower-cased. Null and empty texts are one empty line. A key
of under ``min_chars`` characters is never dropped. Rows with the same id are one document when documents are counted,
null ids together as well; each row keeps a bitmap of its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _row_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(text)


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, k, bitmap): per row with a dropped line, words of 64 lines whose zero bits are the dropped lines."""
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = source.select("doc_id", _row_key(F.col("text")).alias("k"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    # read three times: for the bounds of the ranges, for the ranges, and for the lines that go
    rows = written(rows.select("doc_id", "k", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    ranges = rows.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "k", "pos")
    stream = Window.partitionBy("h1", "h2", "doc_id").orderBy("k", "pos")
    first = ranges.select("h1", "h2", "doc_id", "k", "pos", F.row_number().over(stream).alias("n")).filter("n = 1")
    found = first.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "k", "pos")).alias("first")
    ).filter(F.col("docs") >= min_docs)
    gone = rows.join(found.select("h1", "h2", "first"), ["h1", "h2"]) if keep_first else rows.join(found.select("h1", "h2"), ["h1", "h2"], "left_semi")
    if keep_first:
        gone = gone.filter(~F.struct("doc_id", "k", "pos").eqNullSafe(F.col("first")))
    words = gone.groupBy("doc_id", "k", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("dropped")
    )
    return words.groupBy("doc_id", "k").agg(
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("dropped").alias("kept")))).alias("bitmap")
    )


def dropped_positions(bitmap: Column) -> Column:
    """The line numbers that a bitmap drops, from 0."""
    return F.flatten(F.transform(bitmap, lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["kept"], b) == 0), lambda b: w["word"] * 64 + b
    )))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` (columns of these names are replaced). Rows without a bitmap
    keep their text (null: empty)."""
    text = F.col("text").cast("string")
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text.alias("whole"), _row_key(text).alias("key"))
    right = bitmaps.select(F.col("doc_id").alias("right_id"), F.col("k").alias("right_key"), "bitmap")
    joined = left.join(right, F.col("id").eqNullSafe(F.col("right_id")) & (F.col("key") == F.col("right_key")), "left")
    parts = joined.select("row", "whole", lines(F.col("whole")).alias("lines"), F.coalesce(dropped_positions(F.col("bitmap")), F.expr("array()").cast("array<int>")).alias("gone"))
    parts = parts.select("row", "whole", "lines", "gone", F.size("lines").alias("n"), F.size("gone").alias("dropped"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("gone"))
    kept = F.when(F.col("dropped") == 0, F.coalesce("whole", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    new = {"kept_text": kept, "n_lines": F.col("n").cast("long"), "n_dropped": F.col("dropped").cast("long")}
    old = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new]
    return parts.select(*old, *[v.alias(k) for k, v in new.items()])


ORACLE = f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM f)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
