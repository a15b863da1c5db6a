"""Registered queries of the operators, with SQL twins where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (
    archives, conversation_repair, decontamination, language_id, line_dedup, merkle_manifest, near_dedup, nearest_vectors, sentence_pieces, sequence_packing,
    sharding, tool_calls, url_reputation,
)
from sightline.llm.common import table
from sightline.session import ensure_conf, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_conf(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_language_bitmask_filters")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query("op10_line_dedup_bitmaps", line_dedup.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.dropped_lines(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op2_spaced_seed_decontamination", decontamination.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_sentence_pieces")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    round_trip = sentence_pieces.round_trip(spark, sentence_pieces.load_pieces())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("coded", round_trip("text"))
    return docs.select(
        "doc_id", F.size("coded.ids").cast("long").alias("n_pieces"), F.xxhash64("coded.ids").alias("ids_hash"),
        F.col("text").eqNullSafe(F.col("coded.text")).alias("round_trip"),
    )


@query("op1_robust_pruned_graph")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_vectors.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query("op4_host_reputation", url_reputation.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op6_vector_bin_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


@query("op9_arc_to_warc", archives.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.converted(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_tool_call_linking", tool_calls.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_conversations(table(spark, sf_dir, "conversations"))
    return tool_calls.linked(calls, results, tool_calls.tool_table(spark))


@query("op13_merkle_manifest", merkle_manifest.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle_manifest.manifest(merkle_manifest.leaves(docs, merkle_manifest.tampered_text()))


@query("op11_generalised_lr_repair", conversation_repair.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.report(rows, conversation_repair.damaged(rows))


@query("op12_minimum_bin_slack")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sequence_packing.packed(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
