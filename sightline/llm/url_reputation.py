"""URL filtering by empirical-Bayes host reputation, under explicit rules.

Method. Labelled pages give each host counts of bad outcomes. Hosts, registered domains, suffixes and all pages form a
hierarchy: a level's rate is the mean of a beta posterior whose prior has the mean of the level above, and a strength that
is estimated for the level from how much its groups' rates differ (moments of the beta-binomial). A page is blocked if
the lower bound of its host's bad rate, mean less ``Z`` posterior deviations, exceeds ``LIMIT``. Rules come first: of those
whose host is the page's host or a parent of it and whose path begins the page's path, the longest decides.

Scale. DataFrame functions only. Counts are added up before each shuffle, up the hierarchy from hosts, so a host with a third
of all pages is a few rows per task. Only the page id and URL move, and hosts join back to pages with Spark's skew handling.

The host is what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null URLs and those
without ``://`` have an empty host and path and are judged by the rate of empty hosts. The suffix is the last
label, or the last two if the last has two letters and the one before is a common second-level label; the registered
domain has one label more. Labels of unknown pages and null outcomes count for nothing. Several labels of a page all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
Z, LIMIT = 1.64, 0.5
#: bounds of a prior's strength, in pages
STRENGTH = (1.0, 1000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_levels(df: DataFrame) -> DataFrame:
    """Adds the registered domain and the suffix of ``host``."""
    labels = F.split("host", r"\.", -1)
    two = (F.char_length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(F.size(labels) > 1, -2).otherwise(-1)).isin(*SECOND_LEVEL) & (F.size(labels) > 2)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return df.withColumns({"suffix": F.when(two, last(F.lit(2))).otherwise(last(F.lit(1))), "domain": F.when(two, last(F.lit(3))).otherwise(last(F.lit(2)))})


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits; of equally long ones the first by text."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    pick = lambda value: F.coalesce(*[F.when(fits(r[1], r[2]), F.lit(value(r))) for r in ordered])
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _strength(counts: DataFrame, name: str) -> DataFrame:
    """One row: the prior strength of a level, from the spread of its groups' rates around the common one. All sums are of
    integers or of one double a group."""
    s = counts.filter("n > 0").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("sq"),
    )
    rate = F.col("bad") / F.col("n")
    noise = rate * (1 - rate)
    spread = (F.col("sq") - F.col("n") * rate * rate - (F.col("k") - 1) * noise) / (noise * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)))
    strength = F.when((noise > 0) & (F.col("n") - F.col("nn") / F.col("n") > F.col("k") - 1) & (spread > 0), 1 / spread - 1).otherwise(STRENGTH[1])
    return s.select(F.least(F.greatest(F.coalesce(strength, F.lit(STRENGTH[1])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias(name))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound) of every host of ``pages`` (page_id, host); ``outcomes`` has (page_id, bad: 0 or 1)."""
    seen = outcomes.filter("bad IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    counts = pages.select("page_id", "host").join(seen, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    hosts = with_levels(counts)
    up = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = up(hosts, "domain", "suffix")
    suffixes = up(domains, "suffix")
    top = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean")).scalar()
    kappa = {c: _strength(df, c).scalar() for c, df in (("host", hosts), ("domain", domains), ("suffix", suffixes))}
    posterior = lambda level, prior: (kappa[level] * prior + F.col("bad")) / (kappa[level] + F.col("n"))
    suffixes = suffixes.select("suffix", posterior("suffix", top).alias("above"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", posterior("domain", F.col("above")).alias("above"))
    hosts = hosts.join(domains, ["domain", "suffix"]).withColumns({"mean": posterior("host", F.col("above")), "weight": kappa["host"] + F.col("n")})
    bound = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return hosts.select("host", "n", "bad", F.round("mean", 6).alias("mean"), F.round(bound, 6).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, labelled, bad_rate, bound) of every row of ``pages`` (page_id, url). A labelled page
    (``labels.doc_id`` is its id) is bad if its quality is 0 or it is toxic."""
    host, path = host_and_path(F.col("_url"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    outcomes = labels.filter("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    known = reputation(urls, outcomes)
    rule, verdict = rule_verdict(F.col("host"), F.col("path"))
    own = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    return urls.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("n").cast("long").alias("labelled"), F.col("mean").alias("bad_rate"), "bound",
    )


def _sql_strength(name: str, source: str) -> str:
    return f"""{name} AS (SELECT least(greatest(coalesce(CASE WHEN r * (1 - r) > 0 AND n - nn / n > k - 1 AND spread > 0 THEN 1 / spread - 1 ELSE {STRENGTH[1]} END, {STRENGTH[1]}), {STRENGTH[0]}), {STRENGTH[1]}) AS kappa
  FROM (SELECT *, (sq - n * r * r - (k - 1) * r * (1 - r)) / nullif(r * (1 - r) * (n - nn / n - (k - 1)), 0) AS spread FROM (SELECT *, bad / n AS r FROM (
    SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*)::DOUBLE AS k, sum(n * n)::DOUBLE AS nn, sum(bad * bad / n) AS sq FROM {source} WHERE n > 0))))"""


_LABELS = "string_split(host, '.')"
_TWO = f"(length({_LABELS}[-1]) = 2 AND len({_LABELS}) > 2 AND {_LABELS}[-2] IN {SECOND_LEVEL})"
_FIT = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_ORDERED = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
ORACLE = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad FROM labels
  WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT *, array_to_string({_LABELS}[CASE WHEN {_TWO} THEN -2 ELSE -1 END :], '.') AS suffix,
  array_to_string({_LABELS}[-least(len({_LABELS}), CASE WHEN {_TWO} THEN 3 ELSE 2 END) :], '.') AS domain
  FROM (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
{_sql_strength('kh', 'h')}, {_sql_strength('kd', 'd')}, {_sql_strength('ks', 's')},
s2 AS (SELECT suffix, (ks.kappa * (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM s) + bad) / (ks.kappa + n) AS above FROM s, ks),
d2 AS (SELECT domain, suffix, (kd.kappa * above + bad) / (kd.kappa + n) AS above FROM d JOIN s2 USING (suffix), kd),
h2 AS (SELECT host, n, (kh.kappa * above + bad) / (kh.kappa + n) AS mean, kh.kappa + n AS weight FROM h JOIN d2 USING (domain, suffix), kh),
j AS (SELECT page_id, host, path, n, mean, mean - {Z} * sqrt(mean * (1 - mean) / (weight + 1)) AS bound,
  CASE {" ".join(f"WHEN {_FIT(h, p)} THEN '{h}{p}'" for _, h, p in _ORDERED)} END AS rule,
  CASE {" ".join(f"WHEN {_FIT(h, p)} THEN '{v}'" for v, h, p in _ORDERED)} END AS ruled FROM p JOIN h2 USING (host))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN round(bound, 6) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS labelled, round(mean, 6) AS bad_rate, round(bound, 6) AS bound FROM j
"""
