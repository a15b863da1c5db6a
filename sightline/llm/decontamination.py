"""Benchmark decontamination with spaced seeds: finds documents that hold a passage of a benchmark item, word
substitutions included.

Method. Fixed masks pick six of up to ten neighbouring tokens and ignore the others. The picked tokens are hashed at
every position of the items and of the documents; equal hashes of a mask are hits. Around each hit, the tokens of both
sides are compared at their places: the document holds the item if a window of 13 tokens (the whole item, if shorter) that
starts at most 12 tokens before the hit has at least 80 % equal tokens.

Scale. DataFrame functions only. Documents stay in place: their tokens are cut into blocks of BLOCK positions with the
tokens around them, and a block is all that a row holds, so that a long document needs memory for its tokens once, not for each
hit. A position is first tested against a bit table of all item hashes, which grows with their number up to MOST_WORDS and
reaches tasks as a scalar subquery; only positions that pass it are joined, with 25 tokens around them. Behind the join a hit
is four numbers and its score. A passage that a third of all documents hold is split by the join's skew handling, as each hit
is a row of its own. Seeds carry 25 tokens as well, some 500 times the size of the items' file: more than MOST_BROADCAST of
them are never broadcast, however small the file is.

Tokens are runs of letters and digits, lower-cased. Null and empty texts have none. Items of fewer than six tokens are too
common to search for and never match. Rows with the same id are one document; a null id is reported as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.arrays import explode_items
from sightline.llm.common import TABLE_WORDS, bit_table, might_contain

#: positions of the tokens that each mask picks
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 7, 8), (0, 1, 3, 6, 8, 9), (0, 2, 3, 5, 7, 8))
WINDOW, SHARE = 13, 0.8
TOKEN = r"[\p{L}\p{N}]+"

#: tokens before a position and after it that a window around it can reach
REACH = WINDOW - 1
#: positions in a row
BLOCK = 128
#: 64-bit words of the largest bit table (8 MB); a word a seed lets one position in 250 pass by chance
MOST_WORDS = 1 << 20
MOST_BROADCAST = 100_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))


def _padded(df: DataFrame, key: str) -> DataFrame:
    """(key, w): the tokens of ``text`` between REACH nulls on either side."""
    ends = F.array_repeat(F.lit(None).cast("string"), REACH)
    return df.select(key, F.concat(ends, tokens(F.col("text")), ends).alias("w"))


def _hashes() -> Column:
    """A row for the hash of each mask at position ``at`` of ``w``; null where the mask reaches beyond the last token."""
    word = lambda o: F.get("w", F.col("at") + (REACH + o))
    return F.explode(F.array(*[
        F.when(word(picks[-1]).isNotNull(), F.xxhash64(F.lit(m), *[word(o) for o in picks])) for m, picks in enumerate(MASKS)
    ]))


def _seeds(padded: DataFrame, *carry: str) -> DataFrame:
    """(carry, start, w, at, h): the hashes at each position, ``at`` in a block ``w`` of tokens that starts at ``start``. The
    expression of the blocks has no generated code, so that Spark passes blocks on one by one: what generated code makes
    of a row it gathers before it goes on, with a copy of all that the row carries."""
    last = F.greatest(F.size("w") - 2 * REACH - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last, F.lit(BLOCK)), lambda i: F.struct(i.alias("start"), F.slice("w", i + 1, BLOCK + 2 * REACH).alias("w")))
    blocks = explode_items(padded, list(carry), cut, "block").select(*carry, "block.start", "block.w")
    return blocks.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("*", _hashes().alias("h")).filter("h IS NOT NULL")


def _near() -> Column:
    """The tokens from REACH before a position to as many after it; null beyond the ends."""
    return F.slice("w", F.col("at") + 1, 2 * REACH + 1)


def seeds(benchmark: DataFrame) -> DataFrame:
    """(h, item_id, item_at, item_size, item_near): the seeds of all items."""
    items = _padded(benchmark, "item_id").withColumn("item_size", F.size("w") - 2 * REACH)
    return _seeds(items, "item_id", "item_size").select("item_id", (F.col("start") + F.col("at")).alias("item_at"), "item_size", _near().alias("item_near"), "h")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, first_token, hits): the items that each document holds, the most equal tokens in a
    window, where the first such window starts, and the number of seed hits in such windows."""
    found = seeds(benchmark)
    most = len(MASKS) * (benchmark.agg(F.sum(F.size(tokens(F.col("text")))).alias("n")).first()["n"] or 0)
    n_words = min(max(TABLE_WORDS, 1 << most.bit_length()), MOST_WORDS)
    table = bit_table(found, n_words)
    picked = _seeds(_padded(docs, "doc_id"), "doc_id").filter(might_contain(table, F.col("h"), n_words))
    near = picked.select("doc_id", (F.col("start") + F.col("at")).alias("at"), _near().alias("near"), "h")
    hits = near.join(found.hint("merge") if most > MOST_BROADCAST else found, "h")
    length = F.least("item_size", F.lit(WINDOW))
    # a bit for each place, that of the first one is the highest
    same = F.aggregate(F.zip_with("near", "item_near", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")), F.lit(0), lambda s, x: s * 2 + x)
    # window starts from REACH tokens before the hit to the hit, as far as the window lies in the item
    starts = F.filter(F.sequence(F.lit(-REACH), F.lit(0)), lambda t: (
        (t > -F.col("length")) & (F.col("item_at") + t >= 0) & (F.col("item_at") + t + F.col("length") <= F.col("item_size"))
    ))
    all_places = F.call_function("shiftleft", F.lit(1), F.col("length")) - 1
    matched = lambda s, t: F.bit_count(F.call_function("shiftright", s, F.lit(WINDOW) - t - F.col("length")).bitwiseAND(all_places))
    best = lambda s: F.array_max(F.transform(starts, lambda t: F.struct(matched(s, t).alias("matched"), (-t).alias("before"))))
    # a column ``same`` would be put into the lambda of the windows and made for each of them
    scored = hits.withColumn("length", length).withColumn("best", F.get(F.transform(F.array(same), best), F.lit(0)))
    good = scored.filter(F.col("best.matched") * 10 >= F.col("length") * int(SHARE * 10))
    return good.groupBy("doc_id", "item_id").agg(  # a hit of several masks counts once
        F.max("best.matched").cast("long").alias("matched"), F.min(F.col("at") - F.col("best.before")).cast("long").alias("first_token"),
        F.count_distinct("at", "item_at").alias("hits"),
    )


ORACLE = rf"""
WITH masks(mask, picks) AS (VALUES {", ".join(f"({i}, {list(m)})" for i, m in enumerate(MASKS))}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
bp AS (SELECT item_id, w, unnest(range(len(w))) AS item_at FROM b),
ds AS (SELECT doc_id, p, mask, list_transform(picks, lambda o: dp.w[dp.p + o + 1]) AS key FROM dp, masks WHERE p + picks[6] < len(w)),
bs AS (SELECT item_id, item_at, w, mask, list_transform(picks, lambda o: bp.w[bp.item_at + o + 1]) AS key FROM bp, masks WHERE item_at + picks[6] < len(w)),
hits AS (SELECT DISTINCT ds.doc_id, ds.p, bs.item_id, bs.item_at, bs.w AS iw, least(len(bs.w), {WINDOW}) AS n FROM ds JOIN bs ON ds.mask = bs.mask AND ds.key = bs.key),
tried AS (SELECT h.*, d.w, unnest(range({1 - WINDOW}, 1)) AS t FROM hits h JOIN d ON d.doc_id = h.doc_id),
scored AS (SELECT *, len(list_filter(range(n), lambda x: w[p + t + x + 1] = iw[item_at + t + x + 1] AND p + t + x >= 0)) AS matched
  FROM tried WHERE t > -n AND item_at + t >= 0 AND item_at + t + n <= len(iw)),
best AS (SELECT doc_id, item_id, p, item_at, n, max(matched) AS matched, arg_max(t, matched * 100 - t) AS t FROM scored GROUP BY ALL)
SELECT doc_id, item_id, max(matched) AS matched, min(p + t) AS first_token, count(*) AS hits FROM best WHERE matched * 10 >= n * 8 GROUP BY doc_id, item_id
"""
