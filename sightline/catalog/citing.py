"""Citations, URL forms, page matching and the texts around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import constants as K
from sightline.catalog import query
from sightline.catalog.mining import _sentiment_sql, config
from sightline.catalog.views import bare_host, encoded_sql, host, sql
from sightline.functions import urls
from sightline.operators.citations import answer_cost, attribute_sources, citation_urls, extract_citations, link_reddit
from sightline.operators.matching import keyword_mentions, match_pages
from sightline.operators.mentions import sentiment
from sightline.operators.prompts import merge_sentiment, parse_suggestions, render_templates, suggest_prompts
from sightline.plans.citation_job import extract_and_match, new_responses

C = F.col

# canonical form of the URLs in the test pages: host lower, tracking keys and fragment dropped
_SCHEME_HOST = r"lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]+)', 1))"
_PATH = r"regexp_extract({u}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_PAIRS = r"list_filter(string_split(regexp_extract({u}, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '{keys}'))"
_STRICT = "(?i)^(utm_.*|fbclid|gclid|gclsrc|dclid|msclkid|mc_cid|mc_eid|_ga|_gl|yclid|ref|ref_src|ref_url|igshid|hsCtaTracking)$"


def canonical_sql(u: str) -> str:
    pairs = _PAIRS.replace("{u}", u).replace("{keys}", _STRICT)
    path = f"CASE WHEN {_PATH.replace('{u}', u)} = '' THEN '/' ELSE {_PATH.replace('{u}', u)} END"
    return (
        f"({_SCHEME_HOST.replace('{u}', u)} || CASE WHEN {path} = '/' AND len({pairs}) = 0 THEN '' ELSE {path} END "
        f"|| CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END)"
    )


_CIT = r"\[[^\]]+\]\(https?://[^\s)]+\)|<https?://[^\s<>]+>|\[\d+\][:.\s]+\s*https?://[^\s<>)]+|\bhttps?://[^\s<>\"''\]\[)]+"
_CITED = f"""
found AS (SELECT *, regexp_extract(text, '{_CIT}') AS m, instr(text, regexp_extract(text, '{_CIT}')) - 1 AS position FROM answers WHERE regexp_matches(text, '{_CIT}')),
cited AS (SELECT *, CASE WHEN starts_with(m, '<') THEN m[2:-2] WHEN m LIKE '[%](%' THEN regexp_extract(m, '\\((https?://[^\\s)]+)\\)', 1)
    ELSE regexp_replace(regexp_extract(m, '(https?://.*)$', 1), '[.,;:!?)\\]]+$', '') END AS raw_url FROM found),
citations_x AS (SELECT *, {canonical_sql('raw_url')} AS curl, {host('raw_url')} AS domain FROM cited)
"""


_SNIPPET = """trim(left(trim(substring(text, greatest(0, position - 250)::INT + 1,
  (position + CASE WHEN starts_with(m, 'http') THEN length(raw_url) ELSE length(m) END + 250 - greatest(0, position - 250))::INT), e' \\n\\t\\r'), 500))"""


@query("text_citations", sql(f"""WITH {_CITED.strip()}
SELECT snapshot_id, curl AS url, domain, position, {_SNIPPET} AS snippet FROM citations_x""", "answers"))
def text_citations(t):
    return extract_citations(t.answers()).select("snapshot_id", "url", "domain", "position", F.btrim("snippet").alias("snippet"))


@query("citation_url_lists", sql(r"""
SELECT snapshot_id, CASE WHEN regexp_matches(text, '\]\(https?://') THEN regexp_extract(text, '\]\((https?://[^\s)]+)\)', 1)
  ELSE regexp_replace(regexp_extract(text, '(?i)\bhttps?://[^\s<>()"'']+'), '[.,;:!?)\]}''"`]+$', '') END AS urls
FROM answers WHERE text LIKE '%://%'""", "answers"))
def citation_url_lists(t):
    return t.answers().filter(C("text").contains("://")).select(
        "snapshot_id", F.array_join(citation_urls(C("text")), " ").alias("urls"))


@query("canonical_urls", f"SELECT page_id, {canonical_sql('url')} AS url FROM pages")
def canonical_urls(t):
    return t.raw("pages").select("page_id", urls.canonical(C("url")).alias("url"))


_N_PAIRS = _PAIRS.replace("{u}", "url").replace("{keys}", "(?i)^(utm_|fbclid|gclid|mc_cid|mc_eid|ref|ref_|_hsenc|_hsmi|msclkid)")
_N_PATH = f"CASE WHEN {_PATH.replace('{u}', 'url')} IN ('', '/') THEN '/' ELSE regexp_replace({_PATH.replace('{u}', 'url')}, '/$', '') END"


@query("normalized_urls", f"""
SELECT page_id, regexp_extract(lower(url), '^([a-z]+://)', 1) || {bare_host('url')} || {_N_PATH}
    || CASE WHEN len({_N_PAIRS}) > 0 THEN '?' || array_to_string({_N_PAIRS}, '&') ELSE '' END AS url,
  regexp_extract(lower(url), '^([a-z]+://)', 1) || {bare_host('url')} || {_N_PATH} AS url_without_query FROM pages""")
def normalized_urls(t):
    return t.raw("pages").select(
        "page_id", urls.normalize(C("url")).alias("url"), urls.normalize(C("url"), strip_query=True).alias("url_without_query"))


@query("resolved_links", f"""
SELECT DISTINCT page_id, {_SCHEME_HOST.replace('{u}', 'url')} || {encoded_sql("href")} AS url
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages)""")
def resolved_links(t):
    links = t.raw("pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="(/[^"]*)"'), F.lit(1))).alias("href"))
    return links.select("page_id", urls.resolve(C("href"), C("url")).alias("url")).distinct()


@query("source_attribution", sql(f"""WITH {_CITED.strip()}
SELECT snapshot_id, 'structured' AS source_type, curl AS url, c.domain, c.domain = d.domain OR c.domain LIKE '%.' || d.domain AS is_own_domain
FROM citations_x c LEFT JOIN brand_domains d USING (project_id)
UNION ALL SELECT snapshot_id, 'unstructured', '', '', false FROM answers
WHERE snapshot_id NOT IN (SELECT snapshot_id FROM citations_x) AND contains(lower(text), 'according to experts')""", "answers", "brand_domains"))
def source_attribution(t):
    return attribute_sources(t.answers(), config(t)).select("snapshot_id", "source_type", "url", "domain", "is_own_domain")


@query("provider_sources", sql(f"""WITH {_CITED.strip()},
prov AS (SELECT a.snapshot_id, project_id, regexp_replace(p.url, '#.*$', '') AS purl FROM answers a JOIN pages p ON p.page_id = a.snapshot_id % 97 % n CROSS JOIN np)
SELECT snapshot_id, curl AS url FROM citations_x
UNION ALL SELECT snapshot_id, CASE WHEN regexp_matches(purl, '^[a-z]+://[^/]+$') THEN purl || '/' ELSE purl END FROM prov p
WHERE NOT EXISTS (SELECT 1 FROM citations_x c WHERE c.snapshot_id = p.snapshot_id AND c.curl = p.purl)""".replace("ON p.page_id = a.snapshot_id % 97 % n CROSS JOIN np", "ON p.page_id = a.snapshot_id % 97 % (SELECT n FROM np)"), "answers", "np"))
def provider_sources(t):
    """Text citations together with provider citations not seen in the text."""
    n = t.raw("pages").agg(F.count(F.lit(1)).alias("n"))
    provider = t.answers().crossJoin(F.broadcast(n)).select("snapshot_id", (C("snapshot_id") % 97 % C("n")).alias("page_id")).join(
        t.raw("pages").select("page_id", "url"), "page_id").select("snapshot_id", "url", F.lit("t").alias("title"))
    return attribute_sources(t.answers(), config(t), provider).filter(C("source_type") == "structured").select("snapshot_id", "url")


_MATCH = f"""
w AS (SELECT DISTINCT url, {bare_host('url')} AS h, {_N_PATH} AS p FROM pages),
k AS (SELECT client_page_id, url AS kurl, {bare_host('url')} AS h, {_N_PATH} AS p FROM client_pages),
pairs AS (SELECT w.url, client_page_id, CASE WHEN kurl = w.url THEN 0 WHEN k.p = w.p THEN 1 ELSE 2 END AS cls, levenshtein(k.p, w.p) AS d
  FROM w JOIN k USING (h) WHERE kurl = w.url OR k.p = w.p OR levenshtein(k.p, w.p) <= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY cls, CASE WHEN cls = 2 THEN d ELSE 0 END, client_page_id) AS rn FROM pairs),
matched AS (SELECT w.url, CASE WHEN w.url LIKE '%page=2%' THEN 7 ELSE client_page_id END AS client_page_id,
  CASE WHEN w.url LIKE '%page=2%' THEN 'manual' ELSE coalesce(['exact','path','fuzzy'][cls + 1], 'unmatched') END AS match_type,
  CASE WHEN w.url LIKE '%page=2%' THEN 100 WHEN cls = 0 THEN 100 WHEN cls = 1 THEN 80 WHEN cls = 2 THEN 70 - 10 * d ELSE 0 END AS confidence
  FROM w LEFT JOIN best ON best.url = w.url AND rn = 1)
"""


@query("page_matches", sql(f"WITH {_MATCH.strip()} SELECT url, client_page_id, match_type, confidence::INT AS confidence FROM matched", "client_pages"))
def page_matches(t):
    aliases = t.raw("pages").filter(C("url").contains("page=2")).select("url", F.lit(7).cast("long").alias("client_page_id"))
    return match_pages(t.raw("pages"), t.client_pages(), aliases)


@query("citation_job", sql(f"""WITH {_CITED.strip()},
w AS (SELECT DISTINCT curl AS url, {bare_host('curl')} AS h, {_N_PATH.replace('url', 'curl')} AS p FROM citations_x),
k AS (SELECT client_page_id, url AS kurl, {bare_host('url')} AS h, {_N_PATH} AS p FROM client_pages),
pairs AS (SELECT w.url, CASE WHEN kurl = w.url THEN 0 WHEN k.p = w.p THEN 1 ELSE 2 END AS cls
  FROM w JOIN k USING (h) WHERE kurl = w.url OR k.p = w.p OR levenshtein(k.p, w.p) <= 2)
SELECT coalesce(['exact','path','fuzzy'][c + 1], 'unmatched') AS match_type, count(*) AS urls
FROM (SELECT w.url, min(cls) AS c FROM w LEFT JOIN pairs USING (url) GROUP BY 1) GROUP BY 1""", "answers", "client_pages"))
def citation_job(t):
    responses = t.answers().select(C("snapshot_id").alias("citation_id"), C("text").alias("raw_response"))
    return extract_and_match(responses, t.client_pages()).match_counts


@query("citation_mappings", sql(f"""WITH {_CITED.strip()},
w AS (SELECT DISTINCT curl AS url, {bare_host('curl')} AS h, {_N_PATH.replace('url', 'curl')} AS p FROM citations_x),
k AS (SELECT client_page_id, url AS kurl, {bare_host('url')} AS h, {_N_PATH} AS p FROM client_pages),
pairs AS (SELECT w.url, CASE WHEN kurl = w.url THEN 0 WHEN k.p = w.p THEN 1 ELSE 2 END AS cls, levenshtein(k.p, w.p) AS d
  FROM w JOIN k USING (h) WHERE kurl = w.url OR k.p = w.p OR levenshtein(k.p, w.p) <= 2),
best AS (SELECT url, min((cls, CASE WHEN cls = 2 THEN d ELSE 0 END)) AS b FROM pairs GROUP BY 1)
SELECT snapshot_id AS citation_id, curl AS url, position, {_SNIPPET} AS context_snippet, CASE WHEN b IS NULL THEN 'unmatched' ELSE ['exact','path','fuzzy'][b[1] + 1] END AS match_type,
  (CASE WHEN b IS NULL THEN 0 WHEN b[1] = 0 THEN 100 WHEN b[1] = 1 THEN 80 ELSE 70 - 10 * b[2] END)::INT AS match_confidence
FROM citations_x LEFT JOIN best ON best.url = curl""", "answers", "client_pages"))
def citation_mappings(t):
    responses = t.answers().select(C("snapshot_id").alias("citation_id"), C("text").alias("raw_response"))
    return extract_and_match(responses, t.client_pages()).mappings.withColumn("context_snippet", F.btrim("context_snippet"))


@query("new_responses", sql("""
SELECT citation_id, audit_id, model_name, query_text FROM citations c
WHERE NOT EXISTS (SELECT 1 FROM citations d JOIN earlier_mappings m USING (citation_id) WHERE d.audit_id = c.audit_id AND d.model_name = c.model_name AND d.query_text = c.query_text)""", "citations", "earlier_mappings"))
def new_responses_query(t):
    """Responses whose (audit, model, query) has no mapping yet."""
    c = t.citations()
    return new_responses(c, c.join(t.earlier_mappings().select("citation_id"), "citation_id", "left_semi")).select(
        "citation_id", "audit_id", "model_name", "query_text")


@query("reddit_links", sql("""
SELECT r.citation_id, 'post' AS mention_type, p.reddit_id AS mention_id, 1.0::DOUBLE AS confidence FROM reddit_answers r JOIN posts p ON p.reddit_id = 'p' || conv_id
UNION ALL SELECT r.citation_id, 'comment', c.reddit_id, 1.0 FROM reddit_answers r JOIN comments c ON c.reddit_id = 'c' || conv_id || 'x' || turn * 2""", "reddit_answers", "posts", "comments"))
def reddit_links(t):
    return link_reddit(t.reddit_answers(), t.posts(), t.comments())


_PRICES = ", ".join(f"('{m}', {a}, {b})" for m, a, b in K.MODEL_PRICES)


@query("answer_costs", sql(f"""
SELECT snapshot_id, coalesce(round((input_tokens * i + output_tokens * o)::DECIMAL(38, 2), 0)::DOUBLE / 10000, 0) AS cost_cents
FROM answers LEFT JOIN (VALUES {_PRICES}) p(model, i, o) USING (model)""", "answers"))
def answer_costs(t):
    return t.answers().select("snapshot_id", answer_cost(C("model"), C("input_tokens"), C("output_tokens")).cast("double").alias("cost_cents"))


@query("merged_sentiment", sql("""
WITH l AS (SELECT event_id AS mention_id, CASE WHEN event_id % 5 <> 0 THEN ['positive','neutral','negative'][event_id % 3 + 1] END AS label, event_id % 7 <> 0 AS ok FROM events WHERE event_id % 2 = 0)
SELECT mention_id, CASE WHEN NOT sentiment_override AND label IS NOT NULL AND coalesce(ok, true) THEN label ELSE sentiment END AS sentiment,
  CASE WHEN sentiment_override THEN 'manual' WHEN label IS NOT NULL AND coalesce(ok, true) THEN 'llm' ELSE 'keyword' END AS sentiment_source,
  (CASE WHEN sentiment_override THEN 1.0 WHEN label IS NOT NULL AND coalesce(ok, true) THEN 0.8 WHEN coalesce(ok, true) THEN 0.3 ELSE 0.5 END)::DOUBLE AS sentiment_confidence
FROM mentions LEFT JOIN l USING (mention_id)""", "mentions"))
def merged_sentiment(t):
    k = C("event_id")
    label = F.element_at(F.array(F.lit("positive"), F.lit("neutral"), F.lit("negative")), (k % 3 + 1).cast("int"))
    labels = t.raw("events").filter(k % 2 == 0).select(
        k.alias("mention_id"), F.when(k % 5 != 0, label).alias("label"), F.lit(0.8).alias("label_confidence"), (k % 7 != 0).alias("batch_ok"))
    return merge_sentiment(t.mentions(), labels).select("mention_id", "sentiment", "sentiment_source", "sentiment_confidence")


@query("keyword_mentions", sql("SELECT mention_type, mention_id, brand_id, min(keyword) AS keyword, " + _sentiment_sql("lower(any_value(text))") + """ AS sentiment FROM
 (SELECT 'post' AS mention_type, reddit_id AS mention_id, title || chr(10) || chr(10) || body AS text FROM posts
  UNION ALL SELECT 'comment', reddit_id, body FROM comments WHERE post_id IN (SELECT reddit_id FROM posts))
 JOIN (SELECT c_custkey % 3 AS brand_id, ['that','des','und'][c_custkey % 3 + 1] AS keyword FROM customer GROUP BY 1, 2) ON contains(lower(text), keyword)
GROUP BY 1, 2, 3""", "posts", "comments"))
def keyword_mentions_query(t):
    words = F.array(F.lit("that"), F.lit("des"), F.lit("und"))
    k = C("c_custkey") % 3
    keywords = t.raw("customer").select(k.alias("brand_id"), F.element_at(words, (k + 1).cast("int")).alias("keyword"), F.lit(True).alias("enabled")).distinct()
    return keyword_mentions(t.posts(), t.comments(), keywords, sentiment)


_TPL = "(VALUES ('de', 'intro', 'Was ist {{brand}}?'), ('en', 'intro', 'What is {{ brand }} in {{city}}?'), ('en', 'deep', 'Compare {{brand}}')) t(locale, template_key, content)"


@query("rendered_templates", f"""
SELECT c_custkey AS request_id, CASE WHEN c.locale = 'de' AND k = 'intro' THEN 'Was ist ' || c_name || '?' WHEN k = 'deep' THEN 'Compare ' || c_name ELSE 'What is ' || c_name || ' in {{{{city}}}}?' END AS rendered,
  NOT (c.locale = 'en' OR (c.locale = 'de' AND k = 'intro')) AS used_fallback, CASE WHEN k = 'intro' AND c.locale <> 'de' THEN 'city' ELSE '' END AS unresolved
FROM (SELECT *, ['de','en','fr'][c_custkey % 3 + 1] AS locale, ['intro','deep'][c_custkey % 2 + 1] AS k FROM customer) c""")
def rendered_templates(t):
    s = t.spark
    templates = s.createDataFrame(
        [("de", "intro", "Was ist {{brand}}?"), ("en", "intro", "What is {{ brand }} in {{city}}?"), ("en", "deep", "Compare {{brand}}")],
        "locale string, template_key string, content string")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    k = C("c_custkey")
    requests = t.raw("customer").select(
        k.alias("request_id"), pick(("de", "en", "fr"), k % 3).alias("locale"), pick(("intro", "deep"), k % 2).alias("template_key"), C("c_name").alias("brand"))
    return render_templates(requests, templates, ["brand"], "en").select(
        "request_id", "rendered", "used_fallback", F.array_join("unresolved", ",").alias("unresolved"))


@query("suggested_prompts", """
SELECT c_custkey AS brand_id, replace(replace(p, '{{brand_name}}', c_name), '{{category}}', lower(c_mktsegment)) AS prompt, r::DOUBLE AS relevance
FROM customer JOIN (VALUES ('household', 'Ist {{brand_name}} gut?', 0.9), ('household', 'Beste {{category}} Anbieter', 0.8), ('machinery', '{{brand_name}} Preise', 0.7)) t(i, p, r) ON lower(c_mktsegment) = i""")
def suggested_prompts(t):
    templates = t.spark.createDataFrame(
        [("household", "de", "Ist {{brand_name}} gut?", "brand", 0.9), ("household", "de", "Beste {{category}} Anbieter", "category", 0.8),
         ("machinery", "de", "{{brand_name}} Preise", "price", 0.7)], "industry string, language string, prompt string, category string, relevance double")
    brands = t.raw("customer").select(
        C("c_custkey").alias("brand_id"), C("c_name").alias("brand_name"), F.lit(None).cast("string").alias("domain"),
        F.lower("c_mktsegment").alias("industry"), F.lit("de").alias("language"), F.lit(None).cast("string").alias("keyword"))
    return suggest_prompts(brands, templates).select("brand_id", "prompt", "relevance")


@query("parsed_suggestions", """
SELECT c_custkey AS response_id, c_name AS prompt, CASE WHEN c_custkey % 3 = 0 THEN 'brand' ELSE 'x' END AS category,
  (CASE WHEN c_custkey % 3 = 0 THEN 0.5 WHEN c_custkey % 3 = 1 THEN 1.0 ELSE 0.25 END)::DOUBLE AS relevance FROM customer WHERE c_custkey % 4 <> 3""")
def parsed_suggestions(t):
    k = C("c_custkey")
    entry = F.concat(F.lit('{"prompt":" '), C("c_name"), F.lit('"'), F.when(k % 3 == 1, F.lit(',"category":"x","relevance_score":7')).when(
        k % 3 == 2, F.lit(',"category":"x","relevance_score":0.25')).otherwise(F.lit(',"relevance_score":"n/a"')), F.lit("}"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("```json\n["), entry, F.lit(',{"prompt":" "}]\n```'))).when(
        k % 4 == 3, F.lit("no json")).otherwise(F.concat(F.lit('{"prompts":['), entry, F.lit("]}")))
    return parse_suggestions(t.raw("customer").select(k.alias("response_id"), raw.alias("raw"), F.lit("de").alias("language"))).select(
        "response_id", "prompt", "category", "relevance")
