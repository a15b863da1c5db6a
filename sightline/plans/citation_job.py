"""Citation job: responses -> citations -> page matches -> cited pages and mappings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.citations import extract_citations
from sightline.operators.matching import match_pages

C = F.col


@dataclass(frozen=True)
class CitationFacts:
    cited_pages: DataFrame
    mappings: DataFrame
    match_counts: DataFrame


def new_responses(responses: DataFrame, mapped: DataFrame) -> DataFrame:
    """Drop (audit, model, query) triples that already have mappings, so that a rerun does nothing twice."""
    keys = ["audit_id", "model_name", "query_text"]
    return responses.join(mapped.select(*keys).distinct(), keys, "left_anti")


def extract_and_match(responses: DataFrame, candidates: DataFrame, aliases: DataFrame | None = None) -> CitationFacts:
    """``responses`` (citation_id, raw_response). Cited pages are keyed by their canonical URL."""
    found = extract_citations(responses.select("citation_id", "raw_response"), "citation_id", "raw_response")
    matches = match_pages(found, candidates, aliases)
    pages = found.groupBy("url").agg(F.min("domain").alias("domain")).join(matches, "url").select(
        "url", C("url").alias("canonical_url"), "domain", "client_page_id")
    mappings = found.join(matches, "url").select(
        "citation_id", "url", "position", C("snippet").alias("context_snippet"), "match_type",
        C("confidence").alias("match_confidence"))
    counts = matches.groupBy("match_type").agg(F.count(F.lit(1)).alias("urls"))
    return CitationFacts(pages, mappings, counts)
