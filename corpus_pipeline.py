"""A cleaning pipeline over ``documents``: each stage applies one operator of ``sightline.llm``, its result is written as
Parquet and reread as the next one's documents.

1. ``language``: documents without a letter, or of which the best language contains less than a fifth of the n-grams, go.
2. ``lines``: of lines found in at least ten documents only the first occurrence stays, so that of ten copies of a document
   the first stays whole. Documents that lose all they have go.
3. ``near_duplicates``: of each class of near-duplicates the document with the smallest id stays. Null ids stay.
4. ``benchmark``: documents that hold a passage of a benchmark item go.
5. ``pieces``: every text is encoded, and decoded again; ``text`` is the decoded one.

``n_chars`` follows the text. Further columns of the input are kept as they are; the last stage adds ``ids`` and ``n_pieces``, with a ``_``
behind a name that is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontamination, language_id, line_dedup, near_dedup, sentence_pieces
from sightline.llm.common import fresh, table, written
from sightline.session import ensure_conf, ship_package

#: a text of which no language contains this share of the n-grams is no text of a known language
LEAST_SCORE = 0.2


#: rows of a batch that a Python worker gets at once: texts, and the sets of pairs, can be long
BATCH_ROWS = 256


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with batches small enough for the memory beside an executor's heap."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.filter(~language_id.held_out()))
    own = fresh(docs, "_language")
    found = docs.withColumn(own, language_id.predictor(spark, model)(F.col("text").cast("string")))
    return found.filter((F.col(own)["lang_pred"] != language_id.UNDETERMINED) & (F.col(own)["score"] >= LEAST_SCORE)).select(*docs.columns)


@small_batches
def first_of_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]  # apart, as their names may be those of the operator's columns
    own = docs.select("doc_id", "text", F.struct(F.lit(0).alias("doc_id"), *others).alias("other_columns"))
    kept = line_dedup.apply_bitmaps(own, line_dedup.dropped_lines(own, keep_first=True))
    kept = kept.filter((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[changed.get(c, F.col("other_columns")[c]).alias(c) for c in docs.columns])


@small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dedup.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = decontamination.overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak"]), "left_anti").select(*docs.columns)


@small_batches
def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    round_trip = sentence_pieces.round_trip(spark, sentence_pieces.load_pieces())
    own, ids, n_pieces = fresh(docs, "_coded"), fresh(docs, "ids"), fresh(docs, "n_pieces")
    coded = docs.withColumn(own, round_trip(F.col("text").cast("string")))
    return coded.withColumns({"text": F.col(own)["text"], ids: F.col(own)["ids"], n_pieces: F.size(F.col(own)["ids"]).cast("long")}).drop(own)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("lines", first_of_frequent_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("pieces", as_pieces),
]

#: the language and encoding stages are not expressible in SQL; tests compare the pipeline with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_conf(spark)
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
