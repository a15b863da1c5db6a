"""Lists in answers, rank of brand and competitors, competitor mention counts and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.arrays import explode_items
from sightline.functions.text import mask_urls, trim_ws, whole_word
from sightline.operators.mentions import sentiment_score

C = F.col
NUMBERED = r"(?m)^[ \t]*(\d{1,3})[.)]\s+(.+)$"
BULLET = r"(?m)^[ \t]*[-*+]\s+(.+)$"
HEADED = r"(?m)^#{1,4}\s+(.+)$"
TOP_N = r"(?i)\b(?:top|best)\s+(\d{1,2})\b"
RANK = "struct<rank:int,order:int,entity:string,is_brand:boolean,source:string,confidence:double>"
RANKS = f"array<{RANK}>"


def plain_item(text: Column) -> Column:
    """A list item without bold, italic, code and link marks."""
    for pattern in (r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"`(.+?)`", r"\[(.+?)\]\(.+?\)"):
        text = F.regexp_replace(text, pattern, "$1")
    return trim_ws(text)


def add_list(answers: DataFrame) -> DataFrame:
    """Add ``list_format`` and ``list_items`` of the best list with three items or more (numbered, bullet, headed)."""
    text = C("text")
    found = answers.withColumns(
        {
            "_numbered": F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(2)),
            "_bullet": F.regexp_extract_all(text, F.lit(BULLET), F.lit(1)),
            "_headed": F.regexp_extract_all(text, F.lit(HEADED), F.lit(1)),
        }
    )
    fits = lambda c: F.size(c) >= K.MIN_LIST_ITEMS
    best = (
        F.when(fits("_numbered"), F.struct(F.when(text.rlike(TOP_N), "top-n").otherwise("numbered").alias("f"), C("_numbered").alias("i")))
        .when(fits("_bullet"), F.struct(F.lit("bullet").alias("f"), C("_bullet").alias("i")))
        .when(fits("_headed"), F.struct(F.lit("headed").alias("f"), C("_headed").alias("i")))
    )
    return found.withColumn("_best", best).withColumns(
        {"list_format": C("_best.f"), "list_items": F.transform(C("_best.i"), plain_item)}
    ).drop("_best", "_numbered", "_bullet", "_headed")


def _in_item(item: Column, name: Column) -> Column:
    return F.when(F.length(name) <= 2, F.lower(item) == F.lower(name)).otherwise(F.lower(item).contains(F.lower(name)))


def _rank(rank: Column, order: Column, entity: Column, is_brand: bool, source: str, confidence: Column) -> Column:
    return F.struct(
        rank.cast("int").alias("rank"), order.cast("int").alias("order"), entity.alias("entity"),
        F.lit(is_brand).alias("is_brand"), F.lit(source).alias("source"), confidence.cast("double").alias("confidence"),
    ).cast(RANK)


def add_rankings(df: DataFrame) -> DataFrame:
    """Add ``ranks``: entities found in the best list, else entities by first appearance, none without the brand.

    Needs ``text``, ``brand``, ``names``, ``competitors`` and, if mentions were extracted, ``kept``.
    """
    df = add_list(df)
    sure = F.when(C("list_format").isin("numbered", "top-n"), 0.9).otherwise(0.8)

    def in_list(item: Column, i: Column) -> Column:
        brand = F.when(
            F.exists("names", lambda n: _in_item(item, n)), F.array(_rank(i + 1, F.lit(0), C("brand"), True, "list", sure))
        ).otherwise(F.array().cast(RANKS))
        others = F.transform(
            F.filter("competitors", lambda c: _in_item(item, c)), lambda c: _rank(i + 1, F.lit(1), c, False, "list", sure))
        return F.concat(brand, others)

    listed = F.when(C("list_items").isNotNull(), F.flatten(F.transform("list_items", in_list)))
    df = df.withColumn("_listed", listed)

    text = F.lower("text")
    first_at = lambda name: F.nullif(F.instr(text, F.lower(name)), F.lit(0)) - 1
    brand_at = F.array_min(F.transform("names", first_at))
    if "kept" in df.columns:
        brand_at = F.coalesce(F.try_element_at(F.transform("kept", lambda m: m["at"]), F.lit(1)), brand_at)
    entries = F.concat(
        F.array(F.struct(brand_at.alias("at"), F.lit(0).alias("no"), C("brand").alias("entity"))),
        F.transform("competitors", lambda c, i: F.struct(first_at(c).alias("at"), (i + 1).alias("no"), c.alias("entity"))),
    ).cast("array<struct<at:int,no:int,entity:string>>")
    ordered = F.sort_array(F.filter(entries, lambda e: e["at"].isNotNull()))
    by_appearance = F.transform(
        ordered,
        lambda e, i: F.struct(
            (i + 1).cast("int").alias("rank"), e["no"].alias("order"), e["entity"].alias("entity"), (e["no"] == 0).alias("is_brand"),
            F.lit("mention-order").alias("source"), F.lit(0.6).cast("double").alias("confidence"),
        ).cast(RANK),
    )
    ranks = (
        F.when(trim_ws(C("text")) == "", F.array().cast(RANKS))
        .when(F.exists("_listed", lambda r: r["is_brand"]), C("_listed"))
        .when(brand_at.isNotNull(), by_appearance)
        .otherwise(F.array().cast(RANKS))
    )
    return df.withColumn("ranks", ranks).drop("_listed")


def ranking_rows(df: DataFrame) -> DataFrame:
    carried = [c for c in ("snapshot_id", "project_id", "brand", "ai_engine", "query_text", "queried_at") if c in df.columns]
    rows = explode_items(df, carried, "ranks", "r")
    return rows.select(
        *carried, C("r.rank").alias("rank_position"), "r.entity", "r.is_brand", "r.source", "r.confidence",
        F.when(~C("r.is_brand"), C("r.entity")).alias("competitor_name"),
    )


def add_competitor_counts(df: DataFrame) -> DataFrame:
    """Add ``competitor_counts``: whole-word occurrences outside URLs, per keyword."""
    masked = mask_urls(C("text"))
    df = df.withColumn("_masked", masked) if "_masked" not in df.columns else df
    counts = F.transform(
        "competitors",
        lambda k: F.struct(
            k.alias("keyword"),
            F.when(F.lower("_masked").contains(F.lower(k)), F.size(F.split("_masked", whole_word(k))) - 1).otherwise(0).alias("n"),
        ),
    )
    return df.withColumn("competitor_counts", counts)


def benchmark_rows(df: DataFrame, context_chars: int = K.CONTEXT_CHARS) -> DataFrame:
    """Per answer and competitor: mentions, share of voice, sentiment around the first mention, and rank.

    Needs ``kept`` (brand mentions), ``ranks`` and ``competitor_counts``. Of several ranks the last one counts.
    """
    total = F.size("kept") + F.aggregate("competitor_counts", F.lit(0), lambda a, c: a + c["n"])
    text = C("text")

    def measure(c: Column) -> Column:
        at = F.instr(F.lower(text), F.lower(c["keyword"])) - 1
        start = F.greatest(F.lit(0), at - context_chars)
        window = F.substring(text, start + 1, at + F.length(c["keyword"]) + context_chars - start)
        rank = F.try_element_at(F.filter("ranks", lambda r: ~r["is_brand"] & (r["entity"] == c["keyword"])), F.lit(-1))
        return F.struct(
            c["keyword"].alias("keyword"), c["n"].alias("n"),
            F.when(c["n"] > 0, F.signum(sentiment_score(window))).otherwise(0.0).alias("sentiment"),
            F.coalesce(rank["rank"], F.lit(0)).alias("rank"),
        )

    rows = explode_items(
        df, ["snapshot_id", "project_id", "ai_engine", total.alias("_total")], F.transform("competitor_counts", measure), "c")
    return rows.select(
        "snapshot_id", "project_id", "ai_engine", C("c.keyword").alias("competitor_name"), C("c.n").alias("mention_count"),
        F.when(C("_total") > 0, C("c.n") / C("_total")).otherwise(0.0).alias("share_of_voice"),
        C("c.sentiment").alias("avg_sentiment"), C("c.rank").cast("double").alias("avg_rank"),
    )
