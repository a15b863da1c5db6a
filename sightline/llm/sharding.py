"""Sharding by vector bin packing: shards of nearly equal bytes, tokens and rows together.

Method. Equal texts form a group. Every unit of work (a large group, or a bundle of small ones) is a vector of bytes, tokens
and rows; units are placed from the largest to the smallest, each into the shard where the dot product of its vector with
the shard's residual capacity is highest (both as shares of a shard's capacity).

Scale. Groups under 1 / ``FINE`` of a shard's capacity are bundled by a hash of their text, so there are at most
``shards * FINE`` bundles and as many large groups, whatever the number of documents; only these unit vectors meet in the
one packing task. A group that is more than ``WHOLE`` of a shard is cut into parts by a hash of its rows' ids,
as no shard could take it and stay even; all smaller groups stay together. Texts do not move: rows carry their sizes and hashes
only. Slots are counted within each unit and shifted by the sizes of the units before it in the shard.

The law is ``bytes``. The size is the text's UTF-8 bytes (null: none) plus 8; tokens are runs of other characters than
ASCII white space. Null texts form a group, apart from empty texts. Rows that are equal in id and text are told apart by their slots only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import written

SHARDS = 24
FINE, WHOLE, PART = 512, 0.5, 64
OVERHEAD = 8


def _pack(units: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The shard of each unit and its first slot there."""
    need = units[["bytes", "tokens", "rows"]].to_numpy(np.float64)
    need /= np.maximum(need.sum(0) / shards, 1)
    order = np.lexsort((units["part"], units["unit"], -need.max(1)))  # the same packing, however the rows arrive
    room, shard = np.ones((shards, 3)), np.zeros(len(units), np.int64)
    for i in order:
        shard[i] = k = int(np.argmax(room @ need[i]))
        room[k] -= need[i]
    packed = units[["unit", "part"]].assign(shard=shard.astype(np.int32), rows=units["rows"]).sort_values(["shard", "unit", "part"])
    packed["first"] = packed.groupby("shard")["rows"].cumsum() - packed["rows"]
    return packed[["unit", "part", "shard", "first"]]


def pack(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, tokens, text_crc32, shard, slot`` for every row of ``docs`` (doc_id, text)."""
    text = F.col("text").cast("string")
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text.isNull().alias("none"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"),
    )
    group = ["none", "h", "h2"]
    sums = [F.sum(c).alias(c) for c in ("bytes", "tokens", "rows")]
    groups = rows.groupBy(*group).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = groups.agg(*sums).select(F.array(*[F.greatest(F.col(c), F.lit(1)) / shards for c in ("bytes", "tokens", "rows")])).scalar()
    share = F.greatest(*[F.col(c) / total[i] for i, c in enumerate(("bytes", "tokens", "rows"))])
    # large groups: units of their own (negative numbers), in parts if a shard could not hold them
    large = groups.withColumn("share", share).filter(F.col("share") * FINE > 1)
    large = large.withColumn("parts", F.when(F.col("share") > WHOLE, F.ceil(F.col("share") * PART)).otherwise(1).cast("int")).select(*group, "parts")
    placed = rows.join(large, group, "left").withColumns({
        "unit": F.when(F.col("parts").isNotNull(), -1 - F.shiftrightunsigned(F.xxhash64("h", "h2", "none"), 2)).otherwise(F.pmod(F.col("h"), F.lit(shards * FINE))),
        "part": F.coalesce(F.pmod(F.xxhash64("doc_id", "h2"), F.col("parts")), F.lit(0)).cast("int"),
    })
    units = placed.groupBy("unit", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(batches)
        if own:
            yield _pack(pd.concat(own, ignore_index=True), shards)

    # written before rows take their places from it, so that a task that runs again finds the same packing
    shard_of = written(units.coalesce(1).mapInPandas(run, "unit long, part int, shard int, first long"), "packing")
    within = Window.partitionBy("unit", "part").orderBy("doc_id", "h", "h2", "size")
    numbered = placed.withColumn("n", F.row_number().over(within)).join(shard_of, ["unit", "part"])
    return numbered.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).alias("slot"))
