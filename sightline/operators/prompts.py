"""Prompt templates, prompt suggestions, and merging of supplied sentiment labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import json_text as J

C = F.col
PLACEHOLDER = r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\}\}"


def render(template: Column, variables: dict[str, Column]) -> Column:
    """Fill ``{{name}}`` placeholders; those without a value (null or unknown) stay."""
    out = template
    for name, value in variables.items():
        text = F.regexp_replace(value.cast("string"), r"([\\$])", r"\\$1")
        out = F.when(value.isNull(), out).otherwise(F.regexp_replace(out, F.lit(rf"\{{\{{\s*{name}\s*\}}\}}"), text))
    return out


def unresolved(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)))


def render_templates(requests: DataFrame, templates: DataFrame, variables: list[str], fallback_locale: str) -> DataFrame:
    """Render one template per request, by locale with a fallback locale, and report what stayed open.

    ``requests`` (request_id, locale, template_key, and a column per variable), ``templates`` (locale,
    template_key, content). Without any template ``rendered`` is null.
    """
    own = templates.select("locale", "template_key", C("content").alias("_own"))
    other = templates.filter(C("locale") == fallback_locale).select("template_key", C("content").alias("_other"))
    j = requests.join(own, ["locale", "template_key"], "left").join(other, "template_key", "left")
    rendered = render(F.coalesce("_own", "_other"), {v: C(v) for v in variables})
    return j.withColumn("rendered", rendered).select(
        "request_id", "locale", "template_key", "rendered",
        (C("_own").isNull() & C("_other").isNotNull()).alias("used_fallback"), unresolved(C("rendered")).alias("unresolved"))


def suggest_prompts(brands: DataFrame, templates: DataFrame) -> DataFrame:
    """Fill the templates of a brand's industry and language.

    ``brands`` (brand_id, brand_name, domain, industry, language, keyword), ``templates`` (industry, language,
    prompt, category, relevance). An equi-join, so no brand meets templates of other industries.
    """
    values = {
        "brand_name": C("brand_name"), "domain": F.coalesce("domain", "brand_name"), "category": C("industry"),
        "competitors": F.lit("anderen Anbietern"), "product_category": F.coalesce("keyword", F.lit("Produkte")),
        "brand_industry": C("industry"), "service_category": F.coalesce("keyword", F.lit("Marketing")),
        "integration_target": F.coalesce("keyword", F.lit("Slack")),
    }
    j = brands.join(templates, ["industry", "language"])
    return j.select("brand_id", render(C("prompt"), values).alias("prompt"), "category", "relevance", "language")


def parse_suggestions(responses: DataFrame, key: str = "response_id") -> DataFrame:
    """Prompts from the JSON a model returned (``raw``, ``language``): an array, or an object with ``prompts``.

    Code fences are cut; entries without a prompt are dropped; the score defaults to 0.5 and is clamped to 0..1.
    """
    text = F.btrim(F.regexp_replace("raw", r"^```(?:json)?\s*|\s*```$", ""))
    rows = F.coalesce(J.as_objects(text), J.as_objects(F.try_element_at(J.as_object(text), F.lit("prompts"))))
    r = responses.select(key, "language", F.explode(rows).alias("o"))
    get = lambda name: F.try_element_at(C("o"), F.lit(name))
    score = F.coalesce(get("relevance_score").try_cast("double"), F.lit(0.5))
    return r.filter(F.btrim(get("prompt")) != "").select(
        key, F.btrim(get("prompt")).alias("prompt"), F.coalesce(get("category"), F.lit("brand")).alias("category"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("relevance"), "language")


def merge_sentiment(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """Supplied labels win over keyword sentiment unless a person has set it.

    ``labels`` (mention_id, label, label_confidence, batch_ok) holds what the classifier returned. A mention missing
    from a good batch keeps its keyword sentiment at 0.3, one of a failed batch at 0.5.
    """
    j = mentions.join(labels.select("mention_id", "label", "label_confidence", "batch_ok"), "mention_id", "left")
    locked = F.coalesce("sentiment_override", F.lit(False))
    labelled = ~locked & C("label").isNotNull() & F.coalesce("batch_ok", F.lit(True))
    return j.withColumns(
        {
            "sentiment": F.when(labelled, C("label")).otherwise(C("sentiment")),
            "sentiment_source": F.when(locked, "manual").when(labelled, "llm").otherwise("keyword"),
            "sentiment_confidence": F.when(locked, 1.0).when(labelled, C("label_confidence")).when(
                F.coalesce("batch_ok", F.lit(True)), 0.3).otherwise(0.5),
        }
    ).drop("label", "label_confidence", "batch_ok")
