"""Page audit: pages and side files -> facts -> check results -> scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import urls
from sightline.operators import scoring
from sightline.operators.page_checks import PAGE_RUBRICS, add_page_measures
from sightline.operators.rubrics import CheckRegistry
from sightline.operators.site_checks import SITE_RUBRICS, add_site_measures, site_files
from sightline.sources.html import extract_page_facts

C = F.col


def registry(rubrics: dict) -> CheckRegistry:
    out = CheckRegistry()
    for check_id, build in rubrics.items():
        category, severity, weight = K.CHECKS[check_id]
        out.register(check_id, category, severity, weight, build)
    return out


PAGE_CHECKS = registry(PAGE_RUBRICS)
SITE_CHECKS = registry(SITE_RUBRICS)


def page_features(pages: DataFrame, as_of: str, key: str = "page_id") -> DataFrame:
    return add_page_measures(extract_page_facts(pages, key), as_of)


def audit_pages(pages: DataFrame, as_of: str, checks: CheckRegistry = PAGE_CHECKS, key: str = "page_id") -> DataFrame:
    """Page-level checks in long form. Narrow work only: one Python pass, then native expressions."""
    return checks.run(page_features(pages, as_of, key), key)


def audit_sites(files: DataFrame, checks: CheckRegistry = SITE_CHECKS) -> DataFrame:
    """Site-level checks in long form, keyed by site."""
    return checks.run(add_site_measures(site_files(files)), "site")


def audit_rows(
    pages: DataFrame, files: DataFrame, as_of: str, ids: tuple[str, ...] = K.CHECK_IDS, site_of=None, key: str = "page_id"
) -> DataFrame:
    """(key, checks): all selected checks of each page, its own and those of its site, as an array in one row.

    The site of a page is the origin of its final URL unless ``site_of`` (a column of the key and the URL) gives another
    one. Site checks run once per site; only their results are joined to pages, so no side file meets a page. Pages of a
    site without any side file get the results for missing files. The join is on the site; a site with a third of all
    pages is split by adaptive execution, as its side is a single row.
    """
    site = urls.origin(C("final_url")) if site_of is None else site_of
    own_checks, site_checks = PAGE_CHECKS.subset(ids), SITE_CHECKS.subset(ids)
    features = page_features(pages, as_of, key).withColumn("_site", site)
    own = own_checks.results(features, key, "_site", name="_own") if own_checks.ids() else features.select(key, "_site")
    parts = [C("_own")] if own_checks.ids() else []
    if site_checks.ids():
        of_site = site_files(files)
        found = site_checks.results(add_site_measures(of_site), "site", name="_shared").select(C("site").alias("_of"), "_shared")
        none = pages.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(c) for c in of_site.columns])
        missing = site_checks.results(add_site_measures(none), name="_missing").scalar()
        own = own.join(found, C("_site") == C("_of"), "left")
        parts.append(F.coalesce("_shared", missing))
    return own.select(key, F.concat(*parts).alias("checks"))


def full_audit(
    pages: DataFrame, files: DataFrame, as_of: str, ids: tuple[str, ...] = K.CHECK_IDS, site_of=None, key: str = "page_id"
) -> DataFrame:
    """``audit_rows`` as a long table with one row per page and check."""
    return audit_rows(pages, files, as_of, ids, site_of, key).select(key, F.explode("checks").alias("c")).select(key, "c.*")


def audit_scores(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Overall, category and readiness scores of ``audit_rows``, within the row."""
    return scoring.row_scores(rows, [key])


def audit_summary(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Overall score, number of checks passed, and the band the score falls in, of ``audit_rows``."""
    counted = rows.select(key, "checks", F.size(F.filter("checks", lambda c: c["status"] == "pass")).cast("long").alias("_passed_checks"), F.size("checks").cast("long").alias("_all"))
    scored = scoring.row_scores(counted, [key, "_passed_checks", "_all"])
    band = F.when(C("overall_score") >= 80, "well optimised").when(C("overall_score") >= 50, "needs work").otherwise("hardly visible")
    return scored.select(key, "overall_score", C("_passed_checks").alias("passed"), C("_all").alias("checks"), band.alias("band"))
