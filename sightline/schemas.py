"""Explicit schemas of the stored tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


DDL = {
    "pages": "page_id LONG, input_url STRING, final_url STRING, html STRING, response_time_ms DOUBLE, "
             "status_code INT, redirects ARRAY<STRING>",
    "sub_resources": "site STRING, path STRING, content STRING, status_code INT",
    "check_results": "scan_id LONG, check_id STRING, score INT, status STRING, "
                     "issues ARRAY<STRUCT<criterion: STRING, severity: STRING, got: INT, max: INT>>",
    "answers": "snapshot_id LONG, project_id LONG, ai_engine STRING, query_text STRING, queried_at TIMESTAMP, "
               "model STRING, input_tokens LONG, output_tokens LONG, text STRING, day DATE",
    "brand_names": "project_id LONG, brand STRING, name STRING",
    "brand_domains": "project_id LONG, brand STRING, domain STRING",
    "competitors": "project_id LONG, keyword STRING",
    "mentions": "mention_id LONG, snapshot_id LONG, project_id LONG, brand_name STRING, mention_type STRING, "
                "position INT, context_text STRING, sentiment STRING, sentiment_confidence FLOAT, "
                "sentiment_override BOOLEAN, sentiment_source STRING, mentioned_at TIMESTAMP",
    "rankings": "ranking_id LONG, snapshot_id LONG, project_id LONG, brand_name STRING, ai_engine STRING, "
                "rank_position INT, competitor_name STRING, query_text STRING, ranked_at TIMESTAMP",
    "citations": "citation_id LONG, audit_id LONG, model_name STRING, query_text STRING, raw_response STRING, "
                 "extracted_at TIMESTAMP",
    "cited_pages": "cited_page_id LONG, url STRING, canonical_url STRING, domain STRING, client_page_id LONG",
    "citation_page_mappings": "citation_id LONG, cited_page_id LONG, position INT, context_snippet STRING, "
                              "match_type STRING, match_confidence INT",
    "score_snapshots": "snapshot_id LONG, project_id LONG, overall_score INT, readiness_level INT, "
                       "sub_scores STRUCT<readability: INT, interactivity: INT, transactional: INT>, "
                       "ai_citation_count INT, snapshot_type STRING, created_at TIMESTAMP",
    "milestones": "project_id LONG, milestone_type STRING, milestone_key STRING, triggered_at TIMESTAMP",
    "job_log": "queue STRING, job_id LONG, state STRING, error STRING, ts TIMESTAMP",
    "conversion_events": "request_id LONG, event_type STRING, metadata STRING, created_at TIMESTAMP",
    "posts": "reddit_id STRING, subreddit STRING, title STRING, body STRING, score INT, created_at TIMESTAMP",
    "comments": "reddit_id STRING, post_id STRING, body STRING, score INT, created_at TIMESTAMP",
    "brand_links": "mention_type STRING, mention_id STRING, brand_id LONG, keyword STRING, sentiment STRING",
    "schedules": "schedule_id LONG, project_id LONG, frequency STRING, next_run_at TIMESTAMP, enabled BOOLEAN",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
