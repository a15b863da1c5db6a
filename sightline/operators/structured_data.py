"""JSON-LD blocks of a page as typed objects, without a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import json_text as J
from sightline.functions.text import trim_ws

ITEM = "struct<obj:map<string,string>,context:boolean>"


def _plain(objects: Column) -> Column:
    return F.transform(
        objects, lambda o: F.struct(o.alias("obj"), F.map_contains_key(o, F.lit("@context")).alias("context"))
    ).cast(f"array<{ITEM}>")


def block_items(block: Column) -> Column:
    """Objects in one JSON-LD block: a single object, an array of them, or the members of ``@graph``."""
    obj = J.as_object(block)
    graph = F.try_element_at(obj, F.lit("@graph"))
    context = F.map_contains_key(obj, F.lit("@context"))
    members = F.transform(J.as_objects(graph), lambda o: F.struct(
        o.alias("obj"), (F.map_contains_key(o, F.lit("@context")) | context).alias("context"))).cast(f"array<{ITEM}>")
    return (
        F.when(block.rlike(r"^\s*\["), _plain(J.as_objects(block)))
        .when(graph.rlike(r"^\s*\["), members)
        .when(obj.isNotNull(), _plain(F.array(obj)))
        .otherwise(F.array().cast(f"array<{ITEM}>"))
    )


def _types(obj: Column) -> Column:
    return J.string_list(F.try_element_at(obj, F.lit("@type")))


def _has(obj: Column, prop: str) -> Column:
    return F.try_element_at(obj, F.lit(prop)).isNotNull()


def _is_type(obj: Column, name: str) -> Column:
    return F.exists(_types(obj), lambda t: F.lower(t) == name.lower())


def _text(obj: Column, prop: str) -> Column:
    return F.coalesce(F.try_element_at(obj, F.lit(prop)), F.lit(""))


def add_structured_data(facts: DataFrame) -> DataFrame:
    """Add block counts, the list of objects (``ld``), their types, FAQ and how-to items."""
    valid = F.filter("json_ld", lambda b: F.try_parse_json(b).isNotNull() & (b != ""))
    df = facts.withColumn("ld_valid", valid).withColumn(
        "ld", F.flatten(F.transform("ld_valid", block_items))
    )
    required = F.create_map(
        *[x for t, props in K.REQUIRED_PROPERTIES.items() for x in (F.lit(t), F.array(*[F.lit(p) for p in props]))]
    )
    pairs = F.flatten(
        F.transform(
            "ld",
            lambda i: F.flatten(
                F.transform(
                    _types(i["obj"]),
                    lambda t: F.transform(
                        F.coalesce(F.try_element_at(required, t), F.array().cast("array<string>")),
                        lambda p: F.try_element_at(i["obj"], p).isNotNull(),
                    ),
                )
            ),
        )
    )
    types = F.flatten(F.transform("ld", lambda i: _types(i["obj"])))
    df = df.withColumn("ld_types", types).withColumn("ld_required", pairs)

    faq = F.flatten(
        F.transform(
            F.filter("ld", lambda i: _is_type(i["obj"], "FAQPage")),
            lambda i: F.transform(
                F.filter(
                    F.coalesce(J.as_objects(F.try_element_at(i["obj"], F.lit("mainEntity"))), F.array().cast("array<map<string,string>>")),
                    lambda q: _is_type(q, "Question"),
                ),
                lambda q: F.struct(
                    _text(q, "name").alias("question"),
                    F.coalesce(
                        F.try_element_at(J.as_object(F.try_element_at(q, F.lit("acceptedAnswer"))), F.lit("text")),
                        F.lit(""),
                    ).alias("text"),
                ),
            ),
        )
    )
    how_to = F.flatten(
        F.transform(
            F.filter("ld", lambda i: _is_type(i["obj"], "HowTo")),
            lambda i: F.transform(
                F.filter(
                    F.coalesce(J.as_objects(F.try_element_at(i["obj"], F.lit("step"))), F.array().cast("array<map<string,string>>")),
                    lambda s: _is_type(s, "HowToStep"),
                ),
                lambda s: F.struct(F.lit("").alias("question"), _text(s, "text").alias("text")),
            ),
        )
    )
    df = df.withColumn("faq_items", faq).withColumn("how_to_items", how_to)
    with_length = F.transform(
        F.concat("faq_items", "how_to_items"),
        lambda i: F.struct(
            F.length(trim_ws(F.regexp_replace(i["text"], "<[^>]*>", ""))).alias("chars"),
            i["text"].contains("<").alias("rich"),
        ),
    )
    article = F.array_max(
        F.transform(
            F.filter("ld", lambda i: F.try_element_at(i["obj"], F.lit("@type")).isin(*K.ARTICLE_TYPES)),
            lambda i: sum((_has(i["obj"], p).cast("int") for p in K.ARTICLE_FIELDS), F.lit(0)),
        )
    )
    first_text = lambda prop: F.try_element_at(
        F.filter(
            F.transform("ld", lambda i: F.try_element_at(i["obj"], F.lit(prop))),
            lambda v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]") & (v != ""),
        ),
        F.lit(1),
    )
    return df.withColumns(
        {
            "qa_items": with_length,
            "ld_has_faq": F.exists("ld", lambda i: _is_type(i["obj"], "FAQPage")),
            "ld_has_how_to": F.exists("ld", lambda i: _is_type(i["obj"], "HowTo")),
            "ld_author": F.exists("ld", lambda i: _has(i["obj"], "author")),
            "ld_published": F.exists("ld", lambda i: _has(i["obj"], "datePublished")),
            "ld_modified": F.exists("ld", lambda i: _has(i["obj"], "dateModified")),
            "ld_date_published": first_text("datePublished"),
            "ld_date_modified": first_text("dateModified"),
            "ld_article_fields": article,
            "ld_empty": F.exists(
                "ld",
                lambda i: F.size(F.filter(F.map_keys(i["obj"]), lambda k: ~k.isin("@context", "@type"))) == 0,
            ),
            "ld_no_context": (F.size("ld") > 0) & ~F.exists("ld", lambda i: i["context"]),
        }
    )
