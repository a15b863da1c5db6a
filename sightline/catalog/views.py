"""The derived logical tables in SQL, as common table expressions for the result checks."""

from __future__ import annotations

HOST = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
FULL_HOST = r"lower(regexp_extract({0}, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def bare_host(x: str) -> str:
    return HOST.replace("{0}", x)


def host(x: str) -> str:
    return FULL_HOST.replace("{0}", x)


ENGINE = "['chatgpt','claude','perplexity','gemini']"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql.strip())


_view("np", "SELECT count(*) AS n FROM pages")
_view("ns", "SELECT count(*) AS n FROM supplier")

_view("rich_pages", """
SELECT page_id, url AS final_url,
  replace(replace(html, '</head>',
    CASE WHEN page_id % 2 = 0 THEN '<link rel="canonical" href="' || url || '">' ELSE '' END
    || CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content="' || repeat('d', (page_id % 200)::INT) || '">' ELSE '' END
    || CASE WHEN page_id % 4 = 0 THEN '<meta property="og:title" content="t"><meta property="og:type" content="article">' ELSE '' END
    || CASE WHEN page_id % 5 = 0 THEN '<meta name="robots" content="noindex,follow">' ELSE '' END
    || CASE WHEN page_id % 7 = 0 THEN '<meta property="article:published_time" content="2022-03-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00Z">' ELSE '' END
    || CASE WHEN page_id % 6 = 0 THEN '' ELSE '<script type="application/ld+json">' || CASE page_id % 6
      WHEN 1 THEN '{"@context":"https://schema.org","@type":"Article","headline":"h' || page_id || '","author":"a","datePublished":"2023-0' || page_id % 9 + 1 || '-15"}'
      WHEN 2 THEN '{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"n","url":"' || url || '"},{"@type":"WebSite","name":"n"},{"@type":"WebPage"}]}'
      WHEN 3 THEN '{broken'
      WHEN 4 THEN '{"@context":"https://schema.org","@type":["FAQPage","WebPage"],"name":"f","mainEntity":[{"@type":"Question","name":"Question ' || page_id
        || '?","acceptedAnswer":{"@type":"Answer","text":"short"}},{"@type":"Question","name":"Unseen?","acceptedAnswer":{"@type":"Answer","text":"<p>A long answer with more than fifty characters of text in it.</p>"}}]}'
      ELSE '[{"@type":"Person"},{"@type":"Person","name":"p"}]' END || '</script>' END
    || '</head>'), '<footer>', '<h3>Question ' || page_id || '?</h3>'
    || CASE WHEN page_id % 3 = 1 THEN '<blockquote>q</blockquote><cite>c</cite><time datetime="2023-11-05">x</time>' ELSE '' END
    || CASE WHEN page_id % 4 = 1 THEN '<a href="https://other.example.org/x">o</a><a rel="author" href="/me">me</a>' ELSE '' END
    || '<footer>') AS html
FROM pages
""")

_view("side_files", r"""
SELECT 'site-' || page_id AS site, page_id AS k,
  CASE WHEN page_id % 11 = 0 THEN NULL ELSE CASE page_id % 5
    WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /private' || chr(10) || 'Sitemap: ' || url
    WHEN 1 THEN 'User-agent: GPTBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || '# note' || chr(10) || 'foo bar'
    WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow: /'
    WHEN 3 THEN 'Disallow: /a' || chr(10) || 'nonsense' || chr(10) || 'User-agent: ClaudeBot' || chr(10) || 'Allow: /' || chr(10) || 'Disallow: /x # why' || chr(10) || 'User-agent: claudebot' || chr(10) || 'Disallow: /'
    ELSE ' ' END END AS robots,
  CASE WHEN page_id % 13 = 0 THEN NULL ELSE
    '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    || repeat('<url><loc>' || url || '</loc>' || CASE WHEN page_id % 2 = 0 THEN '<lastmod>2024-01-01</lastmod>' ELSE '' END || '</url>', (page_id % 14)::INT)
    || CASE WHEN page_id % 9 <> 0 THEN '</urlset>' ELSE '' END END AS sitemap,
  CASE WHEN page_id % 7 = 0 THEN '# Full ' || page_id ELSE
    '# Site ' || page_id || chr(10) || CASE WHEN page_id % 3 = 0 THEN '> About the site' || chr(10) ELSE '' END || '## Links' || chr(10)
    || CASE WHEN page_id % 4 <> 0 THEN '- [Home](' || url || '): start page' || chr(10) || '- [Other](/o)' || chr(10) ELSE '' END
    || CASE WHEN page_id % 2 = 0 THEN repeat('More words about this. ', 10) ELSE '<br >' END END AS llms,
  CASE WHEN page_id % 10 = 0 THEN NULL ELSE
    '# Rules ' || page_id || chr(10) || CASE WHEN page_id % 2 = 0 THEN '## Supported bots' || chr(10) || '- action: read' || chr(10) ELSE '## General' || chr(10) END
    || CASE WHEN page_id % 3 = 0 THEN 'Contact: me@example.com' || chr(10) ELSE '' END || repeat('text ', (page_id % 60)::INT) END AS agents,
  CASE page_id % 4
    WHEN 0 THEN '{"mcpServers":{"a":{"url":"' || url || '","transport":"sse","description":"d"},"b":{"transport":"pipe"}}}'
    WHEN 1 THEN '{"mcpServers":[]}'
    WHEN 2 THEN '{bad'
    ELSE '{"mcpServers":{"a":{"url":"' || url || '","transport":"http","description":" "}}}' END AS mcp
FROM pages
""")

_view("answers", f"""
SELECT conv_id * 1000 + turn AS snapshot_id, conv_id % 10 AS project_id, {ENGINE}[conv_id % 4 + 1] AS ai_engine,
  'q' || conv_id % 25 AS query_text,
  TIMESTAMP '2024-01-01' + to_days((conv_id % 30)::INT) + to_hours(turn) AS queried_at,
  ['gpt-4o','claude-sonnet-4-20250514','sonar','gemini-2.0-flash','in-house'][conv_id % 5 + 1] AS model,
  length(c.text) + 20 AS input_tokens, length(c.text) * 3 AS output_tokens,
  CASE conv_id % 5 WHEN 0 THEN 'Top 5 options' || chr(10) || '1. ' || replace(c.text, chr(10), chr(10) || '1. ')
    WHEN 1 THEN '- ' || replace(c.text, chr(10), chr(10) || '- ')
    WHEN 2 THEN '## ' || replace(c.text, chr(10), chr(10) || '## ') ELSE c.text END
  || CASE WHEN conv_id % 4 = 1 THEN ' [src](' || url || ')' WHEN conv_id % 4 = 2 THEN ' <' || url || '>'
    WHEN conv_id % 4 = 3 THEN ' [1]: ' || url || '.' WHEN turn % 4 = 1 THEN ' according to experts this is the best choice'
    ELSE ' see ' || url || ', a poor page' END AS text
FROM conversations c CROSS JOIN np JOIN pages p ON p.page_id = (conv_id * 7 + turn) % np.n
WHERE role = 'assistant'
""", "np")

_view("projects", "SELECT DISTINCT conv_id % 10 AS project_id FROM conversations")
_view("brand_names", """
SELECT project_id, 'brand' || project_id AS brand,
  unnest(CASE project_id % 3 WHEN 0 THEN ['that','is'] WHEN 1 THEN ['des','une'] ELSE ['und','the'] END) AS name
FROM projects
""", "projects")
_view("brand_domains", f"""
SELECT page_id % 10 AS project_id, min({bare_host('url')}) AS domain FROM pages GROUP BY 1
""")
_view("competitors", "SELECT project_id, unnest(['for','der','les','of']) AS keyword FROM projects", "projects")
_view("client_pages", r"""
SELECT page_id AS client_page_id, page_id AS candidate_order, CASE page_id % 4 WHEN 0 THEN url
  WHEN 1 THEN regexp_replace(url, '[?#].*$', '') || '?v=1'
  WHEN 2 THEN regexp_replace(url, '/?([?#].*)?$', '') || 'x'
  ELSE 'https://elsewhere.example/p/' || page_id END AS url
FROM pages
""")
_view("mentions", """
SELECT event_id AS mention_id, (event_id % 150) * 1000 + 1 AS snapshot_id, user_id % 10 AS project_id,
  'brand' || user_id % 7 AS brand_name,
  CASE event_type WHEN 'click' THEN 'recommendation' WHEN 'view' THEN 'comparison' WHEN 'signup' THEN 'citation' ELSE 'passing' END AS mention_type,
  event_id % 97 AS position,
  CASE WHEN value < 150 THEN 'negative' WHEN value < 300 THEN 'neutral' ELSE 'positive' END AS sentiment,
  event_id % 11 = 0 AS sentiment_override, ts AS mentioned_at
FROM events
""")
_view("rankings", f"""
SELECT l_orderkey AS snapshot_id, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS ranking_id, l_suppkey % 10 AS project_id,
  'brand' || l_suppkey % 3 AS brand_name, CASE WHEN l_partkey % 3 <> 0 THEN 'comp' || l_partkey % 3 END AS competitor_name,
  {ENGINE}[l_linenumber % 4 + 1] AS ai_engine, max(l_quantity)::INT % 10 + 1 AS rank_position, max(l_shipdate) AS ranked_at
FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber
""")
_view("check_dim", """
SELECT * FROM (VALUES ('robots-txt','readability',13,0),('sitemap-xml','readability',7,1),('llms-txt','readability',7,2),
  ('schema-org','readability',10,3),('content-structure','readability',10,4),('semantic-quality','readability',10,5),
  ('citation-readiness','readability',8,6),('content-freshness','readability',5,7),('faq-schema','readability',5,8),
  ('meta-tags','readability',11,9),('js-rendering','readability',11,10),('performance','readability',3,11),
  ('webmcp','interactivity',0,12),('agents-md','interactivity',0,13)) t(check_id, category, weight, idx)
""")
_view("check_results", """
SELECT l_orderkey AS scan_id, check_id, (max(l_quantity) * 2)::INT AS score,
  CASE WHEN max(l_discount) >= 0.1 THEN 'error' WHEN max(l_quantity) * 2 < 40 THEN 'fail' WHEN max(l_quantity) * 2 < 80 THEN 'warn' ELSE 'pass' END AS status
FROM lineitem JOIN check_dim ON idx = (l_linenumber - 1) + 7 * (l_partkey % 2)
WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY l_orderkey, check_id
""", "check_dim")
_view("scans", """
SELECT o_orderkey AS scan_id, o_custkey AS user_id, 'site' || o_custkey % 200 || '.example' AS domain, o_orderdate AS scanned_at,
  (floor(o_totalprice)::BIGINT % 101)::INT AS score,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status,
  ['de-DE','en-US','fr-FR','es-ES'][o_orderkey % 4 + 1] AS locale, o_orderkey % 10 = 0 AS is_deleted
FROM orders
""")
_view("score_snapshots", """
SELECT o_orderkey AS snapshot_id, o_custkey % 50 AS project_id, (floor(o_totalprice)::BIGINT % 101)::INT AS overall_score,
  (floor(o_totalprice)::BIGINT % 4)::INT AS readiness_level, (floor(o_totalprice)::BIGINT % 97)::INT AS readability,
  CASE WHEN o_orderkey % 3 <> 0 THEN (floor(o_totalprice)::BIGINT % 89)::INT END AS interactivity,
  CASE WHEN o_orderkey % 5 = 0 THEN (floor(o_totalprice)::BIGINT % 83)::INT END AS transactional,
  (o_orderkey % 37)::INT AS citations, CASE WHEN o_orderkey % 9 = 0 THEN 'baseline' ELSE 'scheduled' END AS snapshot_type,
  o_orderdate AS created_at
FROM orders
""")
_view("citations", f"""
SELECT o_orderkey AS citation_id, o_custkey % 100 AS audit_id, {ENGINE}[o_custkey % 4 + 1] AS model_name,
  'q' || o_custkey % 40 AS query_text, o_orderdate AS extracted_at
FROM orders
""")
_view("audits", "SELECT DISTINCT o_custkey % 100 AS audit_id, o_custkey % 100 % 5 AS user_id, o_custkey % 100 % 10 AS project_id FROM orders")
_view("cited_pages", f"""
SELECT page_id AS cited_page_id, url, {bare_host('url')} AS domain, CASE WHEN page_id % 3 <> 0 THEN page_id % 50 END AS client_page_id FROM pages
""")
_view("mappings", """
SELECT o_orderkey AS citation_id, o_orderkey % n AS cited_page_id, o_orderkey % 10 AS position,
  ['exact','path','fuzzy','unmatched'][o_orderkey % 4 + 1] AS match_type
FROM orders CROSS JOIN np WHERE o_orderkey % 4 <> 3
""", "np")
_view("earlier_mappings", """
SELECT o_orderkey AS citation_id FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey % 200 % 9 <> 0
""")
_view("source_attributions", f"""
SELECT event_id AS attribution_id, event_id AS mention_id, user_id % 10 AS project_id, url, {bare_host('url')} AS domain,
  page_id % 4 = 0 AS is_own_domain, CASE WHEN page_id % 4 = 0 THEN page_id END AS matched_page_id,
  CASE WHEN event_id % 8 = 0 THEN 'unstructured' ELSE 'structured' END AS source_type
FROM events CROSS JOIN np JOIN pages ON page_id = event_id % n
""", "np")
_view("conversion_events", "SELECT event_id AS request_id, event_type, props AS metadata, ts AS created_at, user_id FROM events")
_view("job_log", """
SELECT 'queue' || user_id % 5 AS queue, event_id AS job_id,
  CASE event_type WHEN 'click' THEN 'waiting' WHEN 'view' THEN 'active' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'delayed' ELSE 'failed' END AS state, ts
FROM events
""")
_view("deliveries", """
SELECT user_id AS delivery_id, event_id AS attempt_id, ts AS attempted_at,
  CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 404 ELSE 200 END AS http_status FROM events
""")
_view("posts", """
SELECT 'p' || conv_id AS reddit_id, 'sub' || conv_id % 6 AS subreddit, split_part(text, chr(10), 1) AS title, text AS body, (conv_id % 90)::INT AS score
FROM conversations WHERE turn = 0
""")
_view("comments", """
SELECT 'c' || conv_id || 'x' || turn AS reddit_id, 'p' || conv_id AS post_id, text AS body, (conv_id % 40 + turn)::INT AS score
FROM conversations WHERE turn > 0
""")
_view("brand_links", """
SELECT CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS mention_type,
  CASE WHEN turn = 0 THEN 'p' || conv_id ELSE 'c' || conv_id || 'x' || turn END AS mention_id, conv_id % 4 AS brand_id, 'kw' AS keyword,
  ['positive','neutral','negative'][(conv_id + turn) % 3 + 1] AS sentiment, conv_id * 1000 + turn AS link_id
FROM conversations
""")
_view("ai_links", "SELECT mention_type, mention_id, link_id AS citation_id FROM brand_links WHERE link_id % 7 = 1", "brand_links")
_view("reddit_answers", """
SELECT conv_id * 1000 + turn AS citation_id, conv_id, turn,
  text || ' (' || link || ') ' || link || '/c' || conv_id || 'x' || turn * 2 || ' https://reddit.com/r/x/comments/zz' || conv_id AS raw_response
FROM (SELECT *, 'https://' || CASE turn % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'old.' ELSE '' END || 'reddit.com/r/Sub' || conv_id % 6
  || '/comments/p' || conv_id || '/slug' AS link FROM conversations WHERE role = 'assistant')
""")
_view("invoices", """
SELECT o_orderkey AS invoice_id, o_custkey % n AS affiliate_id, o_custkey AS user_id, round(o_totalprice * 100)::BIGINT AS net_cents,
  o_orderdate AS paid_at, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey % 12000 END AS custom_rate_bps, o_orderkey % 13 <> 0 AS has_payment
FROM orders CROSS JOIN ns
""", "ns")
_view("affiliates", """
SELECT s_suppkey AS affiliate_id, s_suppkey * 3 AS user_id, 'owner' || s_suppkey || '@mail' || s_suppkey % 20 || '.example' AS email,
  CASE WHEN s_suppkey % 9 = 0 THEN 'suspended' ELSE 'active' END AS status
FROM supplier
""")
_view("conversions", """
SELECT o_orderkey AS conversion_id, o_custkey % n AS affiliate_id, o_custkey AS referred_user_id,
  'u' || o_custkey || '@mail' || o_custkey % 400 || '.example' AS email, o_orderdate AS converted_at,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS churned_at
FROM orders CROSS JOIN ns
""", "ns")
_view("clicks", "SELECT l_suppkey % 5 AS affiliate_id, l_shipdate AS clicked_at FROM lineitem")


def sql(body: str, *names: str) -> str:
    """``body`` with the named views (and those they need) in front as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    body = body.strip()
    if not ordered:
        return body
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    views = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    if body.upper().startswith("WITH"):
        rest = body[len("WITH RECURSIVE"):] if recursive else body[len("WITH"):]
        return f"WITH {recursive}{views},\n{rest.strip()}"
    return f"WITH {views}\n{body}"


def encoded_sql(path: str) -> str:
    """A path with all characters outside printable ASCII percent-encoded, in SQL."""
    return f"array_to_string(list_transform(string_split({path}, ''), lambda c: CASE WHEN regexp_matches(c, '^[\\x21-\\x7e]$') THEN c ELSE url_encode(c) END), '')"
