"""Joins of the stored facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.catalog.views import sql
from sightline.operators.matching import by_either_key, latest_children
from sightline.operators.metrics import citation_graph

C = F.col


@query("page_citations", sql("""
SELECT p.client_page_id, c.citation_id, a.user_id, p.domain, m.match_type FROM mappings m JOIN citations c USING (citation_id)
JOIN cited_pages p USING (cited_page_id) JOIN audits a USING (audit_id) WHERE p.client_page_id IS NOT NULL""", "mappings", "citations", "cited_pages", "audits"))
def page_citations(t):
    """Inner join chain page - mapping - citation - audit."""
    g = citation_graph(t.citations(), t.mappings(), t.cited_pages()).filter(C("client_page_id").isNotNull())
    return g.join(t.audits().select("audit_id", "user_id"), "audit_id").select("client_page_id", "citation_id", "user_id", "domain", "match_type")


@query("mention_engines", sql("""
SELECT mention_id, ai_engine FROM mentions LEFT JOIN answers USING (snapshot_id)""", "mentions", "answers"))
def mention_engines(t):
    return t.mentions().join(t.answers().select("snapshot_id", "ai_engine"), "snapshot_id", "left").select("mention_id", "ai_engine")


def linked_mentions(t):
    """Brand links with the post or comment they point to: two joins guarded by the type."""
    links = t.brand_links()
    posts = t.posts().select(C("reddit_id").alias("mention_id"), F.lit("post").alias("mention_type"), C("score").alias("_ps"), C("subreddit").alias("_sub"))
    comments = t.comments().select(C("reddit_id").alias("mention_id"), F.lit("comment").alias("mention_type"), C("score").alias("_cs"), "post_id")
    keys = ["mention_type", "mention_id"]
    cited = t.ai_links().select(*keys, F.lit(True).alias("_cited")).distinct()
    j = links.join(posts, keys, "left").join(comments, keys, "left").join(cited, keys, "left")
    return j.select(
        "link_id", *keys, "brand_id", "sentiment", "post_id", C("_sub").alias("subreddit"), F.coalesce("_ps", "_cs").alias("score"),
        C("_cited").isNotNull().alias("ai_cited"))


@query("linked_mentions", sql("""
SELECT link_id, l.mention_type, l.mention_id, brand_id, coalesce(p.score, c.score) AS score,
  EXISTS (SELECT 1 FROM ai_links a WHERE a.mention_type = l.mention_type AND a.mention_id = l.mention_id) AS ai_cited
FROM brand_links l LEFT JOIN posts p ON l.mention_type = 'post' AND p.reddit_id = l.mention_id
LEFT JOIN comments c ON l.mention_type = 'comment' AND c.reddit_id = l.mention_id""", "brand_links", "posts", "comments", "ai_links"))
def linked(t):
    return linked_mentions(t).select("link_id", "mention_type", "mention_id", "brand_id", "score", "ai_cited")


@query("ai_cited_mentions", sql("""
SELECT link_id, mention_id FROM brand_links l WHERE EXISTS (SELECT 1 FROM ai_links a WHERE a.mention_type = l.mention_type AND a.mention_id = l.mention_id)""", "brand_links", "ai_links"))
def ai_cited(t):
    """Only links that an AI answer cites: a semi-join in place of a filter after the read."""
    return t.brand_links().join(t.ai_links(), ["mention_type", "mention_id"], "left_semi").select("link_id", "mention_id")


@query("subreddit_mentions", sql("""
SELECT link_id FROM brand_links l LEFT JOIN comments c ON l.mention_type = 'comment' AND c.reddit_id = l.mention_id
WHERE (l.mention_type = 'post' AND l.mention_id IN (SELECT reddit_id FROM posts WHERE subreddit = 'sub2'))
  OR (l.mention_type = 'comment' AND c.post_id IN (SELECT reddit_id FROM posts WHERE subreddit = 'sub2'))""", "brand_links", "posts", "comments"))
def subreddit_mentions(t):
    """Links to a post of a subreddit, or to a comment whose post is in it."""
    return t.spark.sql("""
        SELECT link_id FROM {links}
        WHERE (mention_type = 'post' AND mention_id IN (SELECT reddit_id FROM {posts} WHERE subreddit = 'sub2'))
           OR (mention_type = 'comment' AND post_id IN (SELECT reddit_id FROM {posts} WHERE subreddit = 'sub2'))""", links=linked_mentions(t), posts=t.posts())


@query("unscheduled_projects", sql("""
SELECT DISTINCT project_id FROM score_snapshots WHERE project_id NOT IN (SELECT user_id % 60 FROM events WHERE event_type = 'signup' AND value > 480)""", "score_snapshots"))
def unscheduled_projects(t):
    scheduled = t.raw("events").filter((C("event_type") == "signup") & (C("value") > 480)).select((C("user_id") % 60).alias("project_id"))
    return t.score_snapshots().select("project_id").distinct().join(scheduled, "project_id", "left_anti")


@query("latest_fix_status", sql("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY attempted_at DESC, attempt_id DESC) AS rn FROM deliveries)
SELECT c_custkey AS fix_id, attempt_id AS last_attempt, http_status AS last_status FROM customer LEFT JOIN d ON delivery_id = c_custkey AND rn = 1""", "deliveries"))
def latest_fix_status(t):
    """Each fix with its latest child row."""
    fixes = t.raw("customer").select(C("c_custkey").alias("delivery_id"))
    out = latest_children(fixes, t.deliveries(), "delivery_id", ["attempted_at", "attempt_id"], "last_")
    return out.select(C("delivery_id").alias("fix_id"), C("last_attempt_id").alias("last_attempt"), C("last_http_status").alias("last_status"))


@query("pages_by_either_url", """
SELECT page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 7 = 0) OR regexp_replace(url, '[?#].*$', '') IN (SELECT url FROM pages WHERE page_id % 7 = 0)""")
def pages_by_either_url(t):
    pages = t.raw("pages").select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("final_url"))
    wanted = t.raw("pages").filter(C("page_id") % 7 == 0).select(C("url").alias("key"))
    return by_either_key(pages, wanted, ("url", "final_url"), "page_id").select("page_id")
