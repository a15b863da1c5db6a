"""The page-level checks as rubrics over the facts of one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import dates, urls
from sightline.functions.numbers import points, steps, steps_down
from sightline.functions.text import trim_ws
from sightline.operators.rubrics import CRITICAL, MINOR, Criterion, Gate, Rubric
from sightline.operators.structured_data import add_structured_data

C = F.col


def _filled(x: Column) -> Column:
    """Trimmed text, null when empty."""
    t = trim_ws(x)
    return F.when(t != "", t)


def _meta(name: str) -> Column:
    return _filled(F.try_element_at(C("meta_names"), F.lit(name)))


def _prop(name: str) -> Column:
    return _filled(F.try_element_at(C("meta_properties"), F.lit(name)))


def _og(name: str) -> Column:
    """Open Graph value: ``property=`` first; ``name=`` only if there is no such property at all."""
    key = F.lit(f"og:{name}")
    return F.when(F.map_contains_key("meta_properties", key), _prop(f"og:{name}")).otherwise(_meta(f"og:{name}"))


def _tag(name: str) -> Column:
    return F.coalesce(F.try_element_at(C("tag_counts"), F.lit(name)), F.lit(0))


def _mean(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.when(F.size(xs) > 0, total / F.size(xs)).otherwise(0.0)


def _deviation(xs: Column, mean: Column) -> Column:
    """Population standard deviation, 0 for fewer than two values."""
    squares = F.aggregate(xs, F.lit(0).cast("double"), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(xs) > 1, F.sqrt(squares / F.size(xs))).otherwise(0.0)


def add_text_measures(facts: DataFrame) -> DataFrame:
    """Ratios, means and deviations from the counts of the HTML pass."""
    lengths = F.transform(
        F.filter("paragraphs", lambda p: (p["chars"] >= 10) & (p["words"] > 0)), lambda p: p["words"]
    )
    share = lambda a, b: F.coalesce(F.try_divide(C(a), C(b)), F.lit(0.0))
    mean_p, mean_s = _mean(lengths), _mean(C("sentence_words"))
    return facts.withColumns(
        {
            "paragraph_count": F.size(lengths),
            "paragraph_mean": mean_p,
            "paragraph_deviation": _deviation(lengths, mean_p),
            "sentence_mean": mean_s,
            "sentence_deviation": _deviation(C("sentence_words"), mean_s),
            "type_token_ratio": share("distinct_words", "plain_words"),
            "top_word_share": share("top_word_count", "plain_words"),
            "content_share": share("content_words", "word_count"),
        }
    )


def add_page_measures(facts: DataFrame, as_of: str) -> DataFrame:
    """Everything the page rubrics need. ``as_of`` is the reference date for ages (``yyyy-MM-dd``)."""
    df = add_text_measures(add_structured_data(facts))
    now = F.to_timestamp(F.lit(as_of))
    published, modified = _prop("article:published_time"), _prop("article:modified_time")
    sources = F.concat(
        F.array(C("ld_date_published"), C("ld_date_modified"), published, modified), C("time_values")
    )
    newest = F.array_max(F.transform(sources, dates.parse_date))
    changed = F.array_max(F.transform(F.array(C("ld_date_modified"), modified), dates.parse_date))
    levels = F.transform("headings", lambda h: h["level"])
    n = F.size("headings")
    skips = F.size(
        F.filter(
            F.zip_with(F.slice(levels, 1, F.greatest(n - 1, F.lit(0))), F.slice(levels, 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: b > a + 1),
            lambda x: x,
        )
    )
    site = urls.bare_host(C("final_url"))
    visible = F.lower("body_text")
    return df.withColumns(
        {
            "newest_age": dates.days_between(now, newest),
            "modified_age": dates.days_between(now, changed),
            "future_date": F.coalesce(newest > now, F.lit(False)),
            "date_channels": (C("ld_date_published").isNotNull() | C("ld_date_modified").isNotNull()).cast("int")
            + (published.isNotNull() | modified.isNotNull()).cast("int")
            + (F.size("time_values") > 0).cast("int"),
            "heading_skips": F.when(n > 1, skips).otherwise(0),
            "heading_levels": F.size(F.array_distinct(levels)),
            "heading_mean_chars": _mean(F.transform("headings", lambda h: F.length(h["text"]))),
            "heading_duplicates": n - F.size(F.array_distinct(F.transform("headings", lambda h: F.lower(h["text"])))),
            "external_links": F.size(
                F.filter(
                    F.filter("content_links", lambda h: h.rlike(r"(?i)^\s*(https?:)?//")),
                    lambda h: urls.bare_host(F.regexp_replace(trim_ws(h), "^//", "http://")) != site,
                )
            ),
            "canonical_match": F.regexp_replace(urls.resolve(C("canonical"), C("final_url")), "/$", "")
            == F.regexp_replace(F.regexp_replace(C("final_url"), "#.*$", ""), "/$", ""),
            "visible_paragraphs": F.size(F.filter("paragraphs", lambda p: p["chars"] > 20)),
            "text_share_of_bytes": F.coalesce(
                F.try_divide(C("visible_bytes"), C("html_bytes")), F.lit(0.0)
            ),
            "text_share_of_chars": F.when(C("html_chars") < 50, 0.0).otherwise(C("text_chars") / C("html_chars")),
            "first_p_position": F.when(C("node_count") > 0, C("first_p_index") / C("node_count")),
            "visible_questions": F.size(
                F.filter("faq_items", lambda q: (q["question"] != "") & visible.contains(F.lower(q["question"])))
            ),
        }
    )


# --- rubrics --------------------------------------------------------------------------------------


def meta_tags() -> Rubric:
    title, description = _filled(C("title")), _meta("description")
    og = _og("title").isNotNull().cast("int") + _og("description").isNotNull().cast("int")
    duplicates = (C("title_count") > 1).cast("int") + (C("description_count") > 1).cast("int")
    any_tag = title.isNotNull() | description.isNotNull()
    noindex = F.coalesce(F.lower(_meta("robots")).contains("noindex"), F.lit(False))
    return Rubric(
        [
            Criterion("title", points(F.length(title).between(10, 60), 25, points(title.isNotNull(), 17)), 25, CRITICAL),
            Criterion("description", points(F.length(description).between(50, 160), 25, points(description.isNotNull(), 17)), 25),
            Criterion("canonical", points(_filled(C("canonical")).isNotNull(), 15), 15),
            Criterion("language", points(_filled(C("lang")).isNotNull(), 10), 10),
            Criterion("open_graph", points(og == 2, 15, points(og == 1, 8)), 15, MINOR),
            Criterion("no_duplicates", points(any_tag, F.greatest(F.lit(0), 10 - duplicates * 5)), 10),
        ],
        cap=F.when(noindex, 10).otherwise(100),
    )


def content_structure() -> Rubric:
    n, p = F.size("headings"), C("first_p_position")
    return Rubric(
        [
            Criterion("single_h1", points(_tag("h1") == 1, 8, points(_tag("h1") > 1, 4)), 8, CRITICAL),
            Criterion("no_level_skips", F.greatest(F.lit(0), 10 - C("heading_skips") * 3), 10),
            Criterion("heading_depth", points(n > 0, points(C("heading_levels") >= 2, 7, F.lit(3))), 7),
            Criterion("main", points(_tag("main") > 0, 8), 8),
            Criterion("article_or_section", points(_tag("article") + _tag("section") > 0, 6), 6, MINOR),
            Criterion("nav", points(_tag("nav") > 0, 3), 3, MINOR),
            Criterion("header_or_footer", points(_tag("header") + _tag("footer") > 0, 3), 3, MINOR),
            Criterion("paragraphs", steps(_tag("p"), (5, 8), (3, 5), (1, 2)), 8),
            Criterion("text_ratio", steps(C("text_share_of_chars"), (0.25, 7), (0.15, 5), (0.08, 3)), 7),
            Criterion("lists", steps(_tag("ul") + _tag("ol"), (2, 5), (1, 3)), 5, MINOR),
            Criterion("early_answer", steps_down(p, (0.15, 12), (0.3, 8), (0.5, 4)), 12),
            Criterion("answer_in_content", points(p.isNotNull() & C("first_p_in_content"), 8), 8),
            Criterion("heading_length", points(n > 0, points(C("heading_mean_chars") >= 15, 8, points(C("heading_mean_chars") >= 8, 5, 2))), 8, MINOR),
            Criterion("unique_headings", points(n > 0, F.greatest(F.lit(0), 7 - C("heading_duplicates") * 2)), 7, MINOR),
        ]
    )


def semantic_quality() -> Rubric:
    paragraphs, sentences, mean_p, mean_s = C("paragraph_count"), C("sentence_count"), C("paragraph_mean"), C("sentence_mean")
    any_word = C("word_count") > 0
    return Rubric(
        [
            Criterion("word_count", steps(C("word_count"), (300, 10), (150, 7), (50, 4)), 10),
            Criterion("sentence_count", steps(sentences, (10, 5), (5, 3)), 5),
            Criterion("paragraph_count", steps(paragraphs, (5, 7), (3, 5), (1, 2)), 7),
            Criterion("paragraph_length", points(mean_p.between(40, 120), 7, points(mean_p.between(20, 200), 5, points(paragraphs > 0, 2))), 7, MINOR),
            Criterion("paragraph_variety", points(C("paragraph_deviation") > 15, 6, points(C("paragraph_deviation") > 5, 4, points(paragraphs > 1, 2))), 6, MINOR),
            Criterion("vocabulary", points(C("type_token_ratio") >= 0.6, 10, points(C("type_token_ratio") >= 0.4, 7, points(C("type_token_ratio") >= 0.2, 4, points(any_word, 2)))), 10),
            Criterion("repetition", points(C("top_word_share") < 0.03, 5, points(C("top_word_share") < 0.06, 3, points(any_word, 1))), 5, MINOR),
            Criterion("sentence_length", points(mean_s.between(10, 25), 8, points(mean_s.between(8, 35), 5, points(sentences > 0, 2))), 8),
            Criterion("sentence_variety", points(C("sentence_deviation") > 5, 7, points(C("sentence_deviation") > 3, 5, points(sentences > 1, 2))), 7, MINOR),
            Criterion("questions", steps(C("question_count"), (2, 5), (1, 3)), 5, MINOR),
            Criterion("content_share", points(C("content_share") >= 0.6, 15, points(C("content_share") >= 0.4, 10, points(C("content_share") >= 0.2, 5, points(any_word, 2)))), 15),
            Criterion("numbers", steps(C("number_count"), (5, 5), (2, 3)), 5, MINOR),
            Criterion("long_words", steps(C("long_words"), (10, 5), (5, 3), (1, 1)), 5, MINOR),
            Criterion("signals", F.least(F.lit(5), F.floor((C("number_count") + C("long_words")) / 3)), 5, MINOR),
        ]
    )


def citation_readiness() -> Rubric:
    meta_author = _meta("author").isNotNull()
    published, modified = _prop("article:published_time").isNotNull(), _prop("article:modified_time").isNotNull()
    fields = C("ld_article_fields")
    semantic = sum((( _tag(t) > 0).cast("int") for t in ("time", "blockquote", "cite", "dfn")), F.lit(0)) + C(
        "figure_with_caption"
    ).cast("int")
    og_article = F.lower(_prop("og:type")) == "article"
    og_fields = sum((_prop(p).isNotNull().cast("int") for p in K.ARTICLE_OG_PROPERTIES), F.lit(0))
    return Rubric(
        [
            Criterion("author_data", points(C("ld_author") | meta_author, 8), 8),
            Criterion("author_visible", points(C("rel_author") | C("byline"), 4), 4),
            Criterion("author_both", points(C("ld_author") & meta_author, 3), 3, MINOR),
            Criterion("published", points(C("ld_published") | published, 10), 10),
            Criterion("time_element", points(F.size("time_values") > 0, 5), 5, MINOR),
            Criterion("modified_data", points(C("ld_modified"), 6), 6),
            Criterion("modified_meta", points(modified, 4), 4, MINOR),
            Criterion("article_schema", points(fields.isNotNull(), 5), 5),
            Criterion("article_fields", points(fields.isNotNull(), points(fields >= 6, 10, points(fields >= 4, 7, points(fields >= 2, 4, 1)))), 10),
            Criterion("canonical", points(_filled(C("canonical")).isNotNull(), 3), 3, MINOR),
            Criterion("canonical_match", points(_filled(C("canonical")).isNotNull() & C("canonical_match"), 2), 2, MINOR),
            Criterion("external_links", steps(C("external_links"), (3, 8), (1, 5)), 8),
            Criterion("numbers", steps(C("visible_numbers"), (5, 5), (2, 3)), 5, MINOR),
            Criterion("blockquote", points(_tag("blockquote") > 0, 4), 4, MINOR),
            Criterion("cite", points(_tag("cite") > 0, 3), 3, MINOR),
            Criterion("semantic_html", F.least(F.lit(10), semantic * 2), 10, MINOR),
            Criterion("og_article", points(og_article, 4), 4, MINOR),
            Criterion("og_article_fields", points(og_article, F.least(F.lit(6), og_fields * 2)), 6, MINOR),
        ]
    )


def content_freshness() -> Rubric:
    published = _prop("article:published_time").isNotNull()
    visible = F.size("time_values") > 0
    return Rubric(
        [
            Criterion("published_data", points(C("ld_date_published").isNotNull(), 10), 10),
            Criterion("published_meta", points(published, 8), 8),
            Criterion("visible_time", points(visible, 7), 7, MINOR),
            Criterion("newest_date", steps_down(C("newest_age"), (90, 30), (365, 22), (730, 14), (1095, 6)), 30),
            Criterion("modified_date", points(C("modified_age").isNotNull(), points(C("modified_age") <= 90, 20, points(C("modified_age") <= 365, 14, points(C("modified_age") <= 730, 8, 3)))), 20),
            Criterion("channels", steps(C("date_channels"), (3, 15), (2, 10), (1, 5)), 15, MINOR),
            Criterion("date_in_text", points(visible, 10, points(C("date_channels") > 0, 3)), 10, MINOR),
        ]
    )


def js_rendering() -> Rubric:
    w, framework, spa = C("body_words"), C("framework").isNotNull(), C("spa_root").isNotNull()
    n, noscript = F.size("headings"), C("noscript_chars")
    static = (C("external_scripts") == 0) & (C("inline_script_chars") < 500)
    ratio = (C("inline_script_chars") + C("external_scripts") * 20_000) / C("html_chars")
    weight = points(static, 15, points(framework & (w >= 50), 12, steps_down(ratio, (0.3, 12), (0.5, 8), (0.8, 4))))
    has = lambda x: points(F.length(x) > 0, 1)
    return Rubric(
        [
            Criterion("visible_text", steps(w, (100, 30), (50, 22), (20, 15), (5, 8)), 30, CRITICAL),
            Criterion("h1", points(_tag("h1") > 0, 5), 5),
            Criterion("headings", steps(n, (2, 4), (1, 2)), 4),
            Criterion("landmark", points(_tag("main") + _tag("article") > 0, 5), 5),
            Criterion("paragraphs", steps(C("visible_paragraphs"), (3, 6), (1, 3)), 6),
            Criterion("server_rendered", points(framework & (w >= 50), 15, points(framework, 8, points(w >= 50, 10))), 15),
            Criterion("script_weight", points(w >= 5, weight), 15),
            Criterion("fallback", points(w >= 50, 7, points(noscript >= 50, 10, points(noscript > 0, 5))), 10, MINOR),
            Criterion("title", has(trim_ws(C("title"))) * 3, 3),
            Criterion("description", has(_meta("description")) * 3, 3),
            Criterion("open_graph", points(F.map_contains_key("meta_properties", F.lit("og:title")), 2), 2, MINOR),
            Criterion("canonical", points(C("canonical").isNotNull(), 2), 2, MINOR),
        ]
    )


def rendering_class() -> Column:
    """How the page is rendered: static, ssr, partial-hydration, csr-spa or unknown."""
    w, framework = C("body_words"), C("framework").isNotNull()
    return (
        F.when((C("external_scripts") == 0) & (C("inline_script_chars") < 500), "static")
        .when(framework & (w >= 50), "ssr")
        .when(framework, "partial-hydration")
        .when(C("spa_root").isNotNull() & (w < 30), "csr-spa")
        .otherwise("unknown")
    )


def performance() -> Rubric:
    size, share, nodes, blocks, hops = (
        C("html_bytes"), C("text_share_of_bytes"), C("node_count"), C("large_inline_blocks"), C("redirect_count")
    )
    kb = 1024
    return Rubric(
        [
            Criterion("html_size", points(size < 100 * kb, 25, points(size < 500 * kb, 18, points(size < 1024 * kb, 10))), 25),
            Criterion("redirects", points(hops == 0, 15, points(hops == 1, 12, points(hops == 2, 8))), 15),
            Criterion("node_count", points(nodes < 1000, 20, points(nodes < 3000, 15, points(nodes < 5000, 10))), 20),
            Criterion("text_share", points(share > 0.3, 25, points(share > 0.15, 18, points(share > 0.08, 10))), 25),
            Criterion("inline_blocks", steps_down(blocks, (0, 15), (3, 10), (6, 5)), 15, MINOR),
        ]
    )


def schema_org() -> Rubric:
    invalid = F.size("json_ld") - F.size("ld_valid")
    types = C("ld_types")
    relevant = F.array_intersect(types, F.array(*[F.lit(t) for t in K.PRIMARY_TYPES + K.SECONDARY_TYPES]))
    primary = F.arrays_overlap(relevant, F.array(*[F.lit(t) for t in K.PRIMARY_TYPES]))
    required, present = F.size("ld_required"), F.size(F.filter("ld_required", lambda x: x))
    share = F.when(required > 0, F.floor(present * 25 / required)).otherwise(0)
    clean = ~C("ld_empty") & ~C("ld_no_context") & (F.size(types) == F.size(F.array_distinct(types)))
    return Rubric(
        [
            Criterion("present", F.lit(10), 10),
            Criterion("valid_json", points(invalid == 0, 15, points(F.size("ld_valid") > 0, 7)), 15),
            Criterion("typed", points(F.size(types) > 0, 10), 10),
            Criterion("relevant_type", points(primary, 25, points(F.size(relevant) > 0, 15)), 25),
            Criterion("required_properties", points(~primary & (F.size(relevant) > 0), F.least(share, F.lit(15)), share), 25),
            Criterion("several_types", steps(F.size(relevant), (3, 10), (2, 5)), 10, MINOR),
            Criterion("clean", points(clean, 5), 5, MINOR),
        ],
        gates=[
            Gate("no_structured_data", F.size("json_ld") == 0, 0),
            Gate("no_valid_block", F.size("ld_valid") == 0, 10),
        ],
    )


def faq_schema() -> Rubric:
    n = F.size("qa_items")
    long_answers = F.size(F.filter("qa_items", lambda i: i["chars"] > 50))
    rich = F.size(F.filter("qa_items", lambda i: i["rich"]))
    questions = F.size("faq_items")
    return Rubric(
        [
            Criterion("present", F.lit(20), 20),
            Criterion("items", points(n > 0, 20, 10), 20),
            Criterion("answer_length", points(n > 0, F.floor(long_answers * 25 / n)), 25),
            Criterion("item_count", steps(n, (3, 15), (2, 10), (1, 5)), 15, MINOR),
            Criterion("rich_text", points(n > 0, points(rich > n / 2, 10, points(rich > 0, 5))), 10, MINOR),
            Criterion("visible_questions", points(questions > 0, F.floor(C("visible_questions") * 10 / questions)), 10, MINOR),
        ],
        gates=[Gate("no_faq_schema", ~C("ld_has_faq") & ~C("ld_has_how_to"), 0)],
    )


PAGE_RUBRICS = {
    "schema-org": schema_org,
    "content-structure": content_structure,
    "semantic-quality": semantic_quality,
    "citation-readiness": citation_readiness,
    "content-freshness": content_freshness,
    "faq-schema": faq_schema,
    "meta-tags": meta_tags,
    "js-rendering": js_rendering,
    "performance": performance,
}
