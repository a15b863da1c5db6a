"""Mentions, rankings and benchmarks mined from answer texts."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from sightline import constants as K
from sightline.catalog import query
from sightline.catalog.views import bare_host, sql
from sightline.functions.arrays import explode_items
from sightline.operators.mentions import (
    add_matches, brand_config, contextual_matches, exact_matches, extract_mentions, fuzzy_matches, mention_type, sentiment, tokenize,
)
from sightline.operators.near_names import near_names
from sightline.operators.rankings import add_competitor_counts, add_list, add_rankings, benchmark_rows, ranking_rows
from sightline.plans.answer_mining import mine_answers, mined
from sightline.session import checkpoint_dir
from sightline.sources.readers import answers_of_days

C = F.col


def config(t):
    return brand_config(t.brand_names(), t.brand_domains(), t.competitors())


def _match_rows(df):
    return explode_items(df, ["snapshot_id"], "matches", "m").select(
        "snapshot_id", C("m.at").alias("position"), C("m.text").alias("matched_text"),
        F.round("m.confidence", 6).alias("confidence"))


# --- SQL of the strategies -------------------------------------------------------------------------

_SEP = r"""\s,;:!?()\[\]{}"''—–"""
URL = r"https?://[^\s)\]>\"'']+"
_SPAN = f"""
spans AS (SELECT snapshot_id, project_id, text, regexp_extract(text, '{URL}') AS url, instr(text, regexp_extract(text, '{URL}')) - 1 AS url_at FROM answers),
tok0 AS (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '[{_SEP}]*[^{_SEP}]+') AS pieces FROM spans)),
tok1 AS (SELECT snapshot_id, project_id, url, url_at, i, pieces[i] AS piece,
    regexp_replace(regexp_replace(pieces[i], '^[{_SEP}]+', ''), '^[*_`#]+|[*_`#]+$', '', 'g') AS token,
    coalesce(list_sum(list_transform(pieces[1:i-1], lambda x: length(x))), 0) AS before FROM tok0),
tokens AS (SELECT snapshot_id, project_id, i - 1 AS token_no, token, before + instr(piece, token) - 1 AS position,
    url <> '' AND before + instr(piece, token) - 1 >= url_at AND before + instr(piece, token) - 1 < url_at + length(url) AS is_url
  FROM tok1 WHERE token <> ''),
word0 AS (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '[^A-Za-z0-9_]*[A-Za-z0-9_]+') AS pieces FROM spans)),
words AS (SELECT snapshot_id, project_id, url, url_at, regexp_replace(pieces[i], '^[^A-Za-z0-9_]+', '') AS word,
    list_sum(list_transform(pieces[1:i], lambda x: length(x))) - length(regexp_replace(pieces[i], '^[^A-Za-z0-9_]+', '')) AS position FROM word0),
exact AS (SELECT snapshot_id, brand, position, word AS matched_text, 1.0::DOUBLE AS confidence, 3 AS priority FROM words JOIN brand_names USING (project_id)
  WHERE CASE WHEN length(name) > 2 THEN lower(word) = lower(name) ELSE word = name END AND NOT (url <> '' AND position >= url_at AND position < url_at + length(url))),
fuzzy AS (SELECT snapshot_id, brand, position, token AS matched_text,
    (1 - levenshtein(regexp_replace(lower(token), '[^\\x00-\\x7F]', '#', 'g'), name) / greatest(length(token), length(name))) * 0.9 AS confidence, 2 AS priority
  FROM tokens JOIN brand_names USING (project_id)
  WHERE NOT is_url AND length(name) BETWEEN 3 AND 4 AND abs(length(token) - length(name)) <= 2 AND lower(token) <> name
    AND levenshtein(regexp_replace(lower(token), '[^\\x00-\\x7F]', '#', 'g'), name) <= 1),
contextual AS (SELECT snapshot_id, 'brand' || project_id AS brand, url_at AS position, url AS matched_text, 0.85::DOUBLE AS confidence, 1 AS priority
  FROM spans JOIN brand_domains USING (project_id) WHERE url <> '' AND {bare_host('url')} = domain),
sorted AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY position, priority DESC) AS rn, confidence * 10 + priority AS score
  FROM (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy UNION ALL SELECT * FROM contextual) WHERE confidence >= 0.7),
folded AS (
  SELECT snapshot_id, rn, 1 AS grp, position, matched_text, confidence, score FROM sorted WHERE rn = 1
  UNION ALL
  SELECT s.snapshot_id, s.rn, CASE WHEN s.position - f.position < 20 THEN f.grp ELSE f.grp + 1 END,
    CASE WHEN s.position - f.position < 20 AND s.score <= f.score THEN f.position ELSE s.position END,
    CASE WHEN s.position - f.position < 20 AND s.score <= f.score THEN f.matched_text ELSE s.matched_text END,
    CASE WHEN s.position - f.position < 20 AND s.score <= f.score THEN f.confidence ELSE s.confidence END,
    CASE WHEN s.position - f.position < 20 AND s.score <= f.score THEN f.score ELSE s.score END
  FROM folded f JOIN sorted s ON s.snapshot_id = f.snapshot_id AND s.rn = f.rn + 1),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, grp ORDER BY rn DESC) AS last FROM folded) WHERE last = 1 AND grp <= 50)
"""
_ARGS = ("answers", "brand_names", "brand_domains", "competitors")


def _strategy_sql(body: str) -> str:
    return sql(f"WITH RECURSIVE {_SPAN.strip()}\n{body}", *_ARGS)


def _any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def _type_sql(x: str) -> str:
    return (
        f"CASE WHEN {_any(x, K.RECOMMENDATION_PHRASES)} THEN 'recommendation' WHEN {_any(x, K.COMPARISON_PHRASES)} THEN 'comparison' "
        f"WHEN {_any(x, K.CITATION_PHRASES)} THEN 'citation' ELSE 'passing' END"
    )


def _score_sql(x: str) -> str:
    plus = " + ".join(f"contains({x}, '{w}')::INT" for w in K.POSITIVE_WORDS)
    minus = " + ".join(f"contains({x}, '{w}')::INT" for w in K.NEGATIVE_WORDS)
    return f"(({plus}) - ({minus}))"


def _sentiment_sql(x: str) -> str:
    s = _score_sql(x)
    return f"CASE WHEN {s} > 0 THEN 'positive' WHEN {s} < 0 THEN 'negative' ELSE 'neutral' END"


@query("tokens", _strategy_sql("SELECT snapshot_id, token, position, is_url FROM tokens"))
def tokens_query(t):
    return tokenize(t.answers()).select("snapshot_id", "token", "position", "is_url")


@query("exact_brand_matches", _strategy_sql("SELECT snapshot_id, position, matched_text, confidence FROM exact"))
def exact_query(t):
    return _match_rows(add_matches(t.answers(), config(t), {"exact": exact_matches}))


@query("fuzzy_brand_matches", _strategy_sql("SELECT snapshot_id, position, matched_text, round(confidence, 6) AS confidence FROM fuzzy"))
def fuzzy_query(t):
    return _match_rows(add_matches(t.answers(), config(t), {"fuzzy": fuzzy_matches}))


def _near_sql(names: str, columns: str) -> str:
    """Near matches of ``nm`` (project_id, name) by comparing all words and groups; the similarity letter by letter."""
    return _strategy_sql(f"""
, nm AS ({names}),
plain AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY token_no) AS rn FROM tokens WHERE NOT is_url),
groups AS (SELECT snapshot_id, project_id, 1 AS words, token AS text, position FROM plain
  UNION ALL SELECT a.snapshot_id, a.project_id, 2, a.token || ' ' || b.token, a.position FROM plain a JOIN plain b ON b.snapshot_id = a.snapshot_id AND b.rn = a.rn + 1),
low AS (SELECT DISTINCT project_id, words, text, regexp_replace(lower(text), '[^\x00-\x7F]', '#', 'g') AS a FROM groups),
cand AS (SELECT *, levenshtein(a, b) AS distance FROM (
  SELECT DISTINCT project_id, words, text, a, name, lower(name) AS b, length(string_split(name, ' ')) AS n FROM low JOIN nm USING (project_id)
  WHERE length(name) > 2 AND abs(length(a) - length(name)) <= CASE words WHEN 1 THEN 2 ELSE 3 END)
  WHERE (words = 1 OR (words = n AND length(b) > 4)) AND a <> b AND levenshtein(a, b) <= CASE WHEN length(b) <= 4 THEN 1 WHEN length(b) <= 7 THEN 2 ELSE 3 END),
ab AS (SELECT DISTINCT a, b, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM cand WHERE length(b) > 4),
walk AS (SELECT a, b, reach, 0 AS i, []::INT[] AS mine, []::INT[] AS theirs FROM ab
  UNION ALL SELECT a, b, reach, i + 1, CASE WHEN place IS NULL THEN mine ELSE list_append(mine, i::INT) END, CASE WHEN place IS NULL THEN theirs ELSE list_append(theirs, place::INT) END
  FROM (SELECT *, list_min(list_filter(range(greatest(0, i - reach), least(length(b), i + reach + 1)), lambda j: substring(b, j::INT + 1, 1) = substring(a, i::INT + 1, 1) AND NOT list_contains(theirs, j::INT))) AS place FROM walk WHERE i < length(a))),
met AS (SELECT a, b, len(mine) AS m, len(list_filter(range(1, len(mine) + 1), lambda k: substring(a, mine[k] + 1, 1) <> substring(b, list_sort(theirs)[k] + 1, 1))) / 2 AS swaps,
    len(list_filter(range(1, 5), lambda k: k <= length(a) AND k <= length(b) AND substring(a, 1, k::INT) = substring(b, 1, k::INT))) AS prefix FROM walk WHERE i = length(a)),
jw AS (SELECT a, b, jaro + prefix * 0.1::DOUBLE * (1 - jaro) AS jw FROM (SELECT *, CASE WHEN m = 0 THEN 0 ELSE (m / length(a) + m / length(b) + (m - swaps) / m) / 3 END AS jaro FROM met)),
hit AS (SELECT project_id, words, text, name, CASE WHEN length(b) <= 4 THEN 1 - distance / greatest(length(a), length(b)) ELSE jw END * 0.9 AS confidence
  FROM cand LEFT JOIN jw USING (a, b) WHERE length(b) <= 4 OR jw >= CASE WHEN length(b) <= 7 THEN 0.88 ELSE 0.85 END)
SELECT {columns} FROM groups JOIN hit USING (project_id, words, text)""")


@query("fuzzy_long_name_matches", _near_sql(
    "SELECT project_id, unnest(['mentre', 'of the']) AS name FROM projects", "snapshot_id, position, text AS matched_text, round(confidence, 6) AS confidence"))
def fuzzy_long_query(t):
    """Names that use the Jaro-Winkler rule, one of them of two words."""
    names = t.projects().select(
        "project_id", F.lit("long").alias("brand"), F.explode(F.array(*[F.lit(n) for n in ("mentre", "of the")])).alias("name"))
    return _match_rows(add_matches(t.answers(), brand_config(names, t.brand_domains()), {"fuzzy": fuzzy_matches}))


@query("near_names", _near_sql("""
SELECT DISTINCT project_id, unnest([word, word || ' ' || next]) AS name FROM (
  SELECT item_id % 10 AS project_id, words[k] AS word, words[k + 1] AS next FROM (SELECT *, unnest(range(1, len(words))) AS k FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS words FROM benchmark)))""",
    "snapshot_id, name, position, text AS matched_text, round(confidence, 6) AS confidence"))
def near_names_query(t):
    """Words and pairs of words of all benchmark items, as names of ten projects, in the answers of these projects."""
    words = t.raw("benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.slice("w", k, 2)))
    names = explode_items(words, ["item_id"], pairs, "pair").select(
        (C("item_id") % 10).alias("project_id"), F.explode(F.array(C("pair")[0], F.array_join("pair", " "))).alias("name"))
    return near_names(t.answers(), names).select(
        "snapshot_id", "name", "position", "matched_text", F.round("confidence", 6).alias("confidence"))


@query("domain_matches", _strategy_sql("SELECT snapshot_id, position, matched_text, confidence FROM contextual"))
def contextual_query(t):
    return _match_rows(add_matches(t.answers(), config(t), {"contextual": contextual_matches}))


@query("deduped_matches", _strategy_sql("SELECT snapshot_id, position, matched_text, round(confidence, 6) AS confidence FROM kept"))
def deduped_query(t):
    return extract_mentions(t.answers(), config(t)).select(
        "snapshot_id", "position", "matched_text", F.round("confidence", 6).alias("confidence"))


_CTX = "trim(substring(text, greatest(0, position - 150)::INT + 1, (position + length(matched_text) + 150 - greatest(0, position - 150))::INT), e' \\n\\t\\r')"


@query("mentions_extracted", _strategy_sql(f"""
SELECT snapshot_id, position, context_text,
  CASE WHEN position / length(text) < 0.33 THEN 'top' WHEN position / length(text) < 0.66 THEN 'middle' ELSE 'bottom' END AS relative_position,
  {_type_sql('lower(context_text)')} AS mention_type, {_sentiment_sql('lower(context_text)')} AS sentiment
FROM (SELECT k.snapshot_id, text, position, {_CTX} AS context_text FROM kept k JOIN answers a USING (snapshot_id))"""))
def mentions_query(t):
    return extract_mentions(t.answers(), config(t)).select(
        "snapshot_id", "position", "context_text", "relative_position", "mention_type", "sentiment")


@query("context_classes", f"""
SELECT {_type_sql('lower(text)')} AS mention_type, {_sentiment_sql('lower(text)')} AS sentiment, count(*) AS texts FROM documents GROUP BY 1, 2""")
def context_classes(t):
    """Mention type and keyword sentiment over whole documents."""
    d = t.raw("documents")
    return d.groupBy(mention_type(C("text")).alias("mention_type"), sentiment(C("text")).alias("sentiment")).agg(
        F.count(F.lit(1)).alias("texts"))


# --- lists, ranks, benchmarks -------------------------------------------------------------------------

_LISTS = r"""
l0 AS (SELECT *, regexp_extract_all(text, '(?m)^[ \t]*\d{1,3}[.)]\s+(.+)$', 1) AS nu, regexp_extract_all(text, '(?m)^[ \t]*[-*+]\s+(.+)$', 1) AS bu,
    regexp_extract_all(text, '(?m)^#{1,4}\s+(.+)$', 1) AS he FROM answers),
lists AS (SELECT *, CASE WHEN len(nu) >= 3 THEN CASE WHEN regexp_matches(text, '(?i)\b(?:top|best)\s+\d{1,2}\b') THEN 'top-n' ELSE 'numbered' END
    WHEN len(bu) >= 3 THEN 'bullet' WHEN len(he) >= 3 THEN 'headed' END AS list_format FROM l0),
items AS (SELECT *, list_transform(CASE list_format WHEN 'bullet' THEN bu WHEN 'headed' THEN he ELSE nu END,
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '`(.+?)`', '\1', 'g'), '\[(.+?)\]\(.+?\)', '\1', 'g'))) AS its
  FROM lists WHERE list_format IS NOT NULL)
"""


@query("answer_lists", sql(f"WITH {_LISTS.strip()} SELECT snapshot_id, list_format, len(its) AS items, its[1] AS first_item FROM items", "answers"))
def answer_lists(t):
    return add_list(t.answers()).filter(C("list_format").isNotNull()).select(
        "snapshot_id", "list_format", F.size("list_items").alias("items"), F.element_at("list_items", 1).alias("first_item"))


_RANKS = _LISTS.strip() + """,
cfg AS (SELECT project_id, brand, list(name ORDER BY name) AS names FROM brand_names GROUP BY 1, 2),
ents AS (SELECT project_id, brand AS entity, true AS is_brand, 0 AS no, names FROM cfg
  UNION ALL SELECT project_id, keyword, false, row_number() OVER (PARTITION BY project_id ORDER BY keyword), [keyword] FROM competitors),
listed0 AS (SELECT snapshot_id, i AS rank_position, entity, is_brand, no, list_format FROM (SELECT *, unnest(range(1, len(its) + 1)) AS i FROM items) JOIN ents USING (project_id)
  WHERE len(list_filter(names, lambda n: CASE WHEN length(n) <= 2 THEN lower(its[i]) = lower(n) ELSE contains(lower(its[i]), lower(n)) END)) > 0),
listed AS (SELECT snapshot_id, rank_position, entity, is_brand, 'list' AS source, CASE WHEN list_format IN ('numbered', 'top-n') THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM listed0
  WHERE snapshot_id IN (SELECT snapshot_id FROM listed0 WHERE is_brand)),
firsts AS (SELECT snapshot_id, entity, is_brand, no, list_min(list_transform(list_filter(names, lambda n: contains(lower(text), lower(n))), lambda n: instr(lower(text), lower(n)))) AS at0
  FROM answers JOIN ents USING (project_id) WHERE snapshot_id NOT IN (SELECT snapshot_id FROM listed)),
appear AS (SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY {AT}, no) AS rank_position, entity, is_brand, 'mention-order' AS source, 0.6::DOUBLE AS confidence
  FROM firsts {JOIN} WHERE {AT} IS NOT NULL AND snapshot_id IN (SELECT snapshot_id FROM firsts {JOIN} WHERE is_brand AND {AT} IS NOT NULL)),
ranks AS (SELECT * FROM listed UNION ALL SELECT * FROM appear)
"""


@query("answer_rankings", sql(
    f"WITH {_RANKS.replace('{AT}', 'at0').replace('{JOIN}', '').strip()} SELECT snapshot_id, rank_position, entity, is_brand, source, confidence FROM ranks",
    "answers", "brand_names", "competitors"))
def answer_rankings(t):
    ranked = add_rankings(t.answers().join(config(t), "project_id"))
    return ranking_rows(ranked).select("snapshot_id", "rank_position", "entity", "is_brand", "source", "confidence")


_WORDS = "list_filter(string_split_regex({0}, '[^A-Za-z0-9_]+'), lambda w: CASE WHEN length(keyword) > 2 THEN lower(w) = keyword ELSE w = keyword END)"
_NO_URL = f"regexp_replace(text, '{URL}', ' ', 'g')"


@query("competitor_counts", sql(f"""
SELECT snapshot_id, keyword, len({_WORDS.replace('{0}', _NO_URL)}) AS mentions FROM answers JOIN competitors USING (project_id)""", "answers", "competitors"))
def competitor_counts(t):
    rows = add_competitor_counts(t.answers().join(config(t), "project_id"))
    return explode_items(rows, ["snapshot_id"], "competitor_counts", "c").select(
        "snapshot_id", "c.keyword", C("c.n").cast("long").alias("mentions"))


_BRAND_AT = "CASE WHEN is_brand THEN coalesce(first_at + 1, at0) ELSE at0 END"
_RANKS_FULL = _RANKS.replace("{AT}", _BRAND_AT).replace(
    "{JOIN}", "LEFT JOIN (SELECT snapshot_id, min(position) AS first_at FROM kept GROUP BY 1) USING (snapshot_id)")
_SOV = f"""
n AS (SELECT snapshot_id, project_id, ai_engine, text, keyword, len({_WORDS.replace('{0}', _NO_URL)}) AS mentions FROM answers JOIN competitors USING (project_id)),
tot AS (SELECT snapshot_id, sum(mentions) AS all_mentions FROM n GROUP BY 1),
own AS (SELECT snapshot_id, count(*) AS own FROM kept GROUP BY 1),
lastrank AS (SELECT snapshot_id, entity, arg_max(rank_position, rank_position) AS rk FROM ranks WHERE NOT is_brand GROUP BY 1, 2)
"""


@query("competitor_benchmarks", _strategy_sql(f"SELECT 1").replace("SELECT 1", "").rstrip() + ",\n" + _RANKS_FULL.strip() + ",\n" + _SOV.strip() + f"""
SELECT snapshot_id, keyword AS competitor_name, mentions AS mention_count,
  round(CASE WHEN all_mentions + coalesce(own, 0) > 0 THEN mentions / (all_mentions + coalesce(own, 0)) ELSE 0 END, 6) AS share_of_voice,
  CASE WHEN mentions > 0 THEN sign({_score_sql("lower(substring(text, greatest(0, instr(lower(text), keyword) - 1 - 150)::INT + 1, (instr(lower(text), keyword) - 1 + length(keyword) + 150 - greatest(0, instr(lower(text), keyword) - 1 - 150))::INT))")})::DOUBLE ELSE 0.0::DOUBLE END AS avg_sentiment,
  coalesce(rk, 0)::DOUBLE AS avg_rank
FROM n JOIN tot USING (snapshot_id) LEFT JOIN own USING (snapshot_id) LEFT JOIN lastrank ON lastrank.snapshot_id = n.snapshot_id AND entity = keyword""")
def competitor_benchmarks(t):
    rows = benchmark_rows(mined(t.answers(), config(t)))
    return rows.select("snapshot_id", "competitor_name", C("mention_count").cast("long").alias("mention_count"),
                       F.round("share_of_voice", 6).alias("share_of_voice"), "avg_sentiment", "avg_rank")


@query("answers_on_event_days", sql("""
SELECT snapshot_id, project_id, strftime(queried_at, '%Y-%m-%d') AS day, text FROM answers
WHERE (project_id, strftime(queried_at, '%Y-%m-%d')) IN (SELECT user_id % 10, strftime(ts, '%Y-%m-%d') FROM events WHERE value > 90)""", "answers"))
def answers_on_event_days(t):
    """Answers stored by day; the days with large events prune the scan through the join."""
    path = f"{checkpoint_dir(t.spark)}/answers-{uuid4().hex}"
    t.answers().withColumn("day", F.to_date("queried_at")).repartition("day").write.partitionBy("day").parquet(path)
    days = t.raw("events").filter(C("value") > 90).select((C("user_id") % 10).alias("project_id"), F.to_date("ts").alias("day"))
    found = answers_of_days(t.spark.read.parquet(path), days)
    return found.select("snapshot_id", "project_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "text")


@query("answer_facts", _strategy_sql("SELECT 1").replace("SELECT 1", "").rstrip() + ",\n" + _RANKS_FULL.strip() + """
SELECT 'mentions' AS fact, (SELECT count(*) FROM kept) AS n UNION ALL SELECT 'rankings', (SELECT count(*) FROM ranks)
UNION ALL SELECT 'benchmarks', (SELECT count(*) FROM answers JOIN competitors USING (project_id)) UNION ALL SELECT 'costs', (SELECT count(*) FROM answers)
UNION ALL SELECT 'attributions', (SELECT count(*) FROM spans WHERE snapshot_id IN (SELECT snapshot_id FROM kept) AND (url <> '' OR contains(text, 'according to experts')))""")
def answer_facts(t):
    """The whole answer job: row counts of the four fact tables and the costs."""
    facts = mine_answers(t.answers(), config(t)).tables()
    out = None
    for name, df in facts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fact"), "n")
        out = row if out is None else out.unionByName(row)
    return out
