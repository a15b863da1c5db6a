"""Logical tables derived from the test tables (TPC-H-like tables, events, documents, pages, conversations).

Every column is a deterministic expression of the source row, so that the same table can be stated in SQL for
the result checks (``sightline.catalog.views``). Nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import urls
from sightline.sources.readers import spread

C = F.col


class TestTables:
    """The driver tables of one scale factor and the logical tables on top of them."""

    __test__ = False

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # --- pages and side files ---------------------------------------------------------------------

    def pages(self) -> DataFrame:
        return spread(self.raw("pages")).select("page_id", C("url").alias("final_url"), "html")

    def rich_pages(self) -> DataFrame:
        """Pages with a head and body extended by tags that the plain test pages lack, chosen by page id."""
        k = C("page_id")
        url = C("url")
        ld = (
            F.when(k % 6 == 0, F.lit(""))
            .when(k % 6 == 1, F.concat(
                F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"h'),
                k, F.lit('","author":"a","datePublished":"2023-0'), (k % 9 + 1), F.lit('-15"}</script>')))
            .when(k % 6 == 2, F.concat(
                F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"n","url":"'),
                url, F.lit('"},{"@type":"WebSite","name":"n"},{"@type":"WebPage"}]}</script>')))
            .when(k % 6 == 3, F.lit('<script type="application/ld+json">{broken</script>'))
            .when(k % 6 == 4, F.concat(
                F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@type":["FAQPage","WebPage"],"name":"f","mainEntity":['
                      '{"@type":"Question","name":"Question '), k, F.lit('?","acceptedAnswer":{"@type":"Answer","text":"short"}},'
                      '{"@type":"Question","name":"Unseen?","acceptedAnswer":{"@type":"Answer","text":"<p>A long answer with more than fifty characters of text in it.</p>"}}]}</script>')))
            .otherwise(F.lit('<script type="application/ld+json">[{"@type":"Person"},{"@type":"Person","name":"p"}]</script>'))
        )
        head = F.concat(
            F.when(k % 2 == 0, F.concat(F.lit('<link rel="canonical" href="'), url, F.lit('">'))).otherwise(F.lit("")),
            F.when(k % 3 == 0, F.concat(F.lit('<meta name="description" content="'), F.repeat(F.lit("d"), (k % 200).cast("int")), F.lit('">'))).otherwise(F.lit("")),
            F.when(k % 4 == 0, F.lit('<meta property="og:title" content="t"><meta property="og:type" content="article">')).otherwise(F.lit("")),
            F.when(k % 5 == 0, F.lit('<meta name="robots" content="noindex,follow">')).otherwise(F.lit("")),
            F.when(k % 7 == 0, F.concat(F.lit('<meta property="article:published_time" content="2022-03-'), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit('T10:00:00Z">'))).otherwise(F.lit("")),
            ld, F.lit("</head>"),
        )
        body = F.concat(
            F.lit("<h3>Question "), k, F.lit("?</h3>"),
            F.when(k % 3 == 1, F.lit('<blockquote>q</blockquote><cite>c</cite><time datetime="2023-11-05">x</time>')).otherwise(F.lit("")),
            F.when(k % 4 == 1, F.lit('<a href="https://other.example.org/x">o</a><a rel="author" href="/me">me</a>')).otherwise(F.lit("")),
            F.lit("<footer>"),
        )
        # the markers occur once per page, as the page builder writes them
        html = F.regexp_replace(C("html"), "</head>", F.lit("\x01"))
        html = F.regexp_replace(html, "<footer>", F.lit("\x02"))
        html = F.replace(F.replace(html, F.lit("\x01"), head), F.lit("\x02"), body)
        return spread(self.raw("pages")).select("page_id", C("url").alias("final_url"), html.alias("html"))

    def side_files(self) -> DataFrame:
        """Side files per page's site (one site per page id), in the shapes the side-file checks tell apart."""
        k, url = C("page_id"), C("url")
        site = F.concat(F.lit("site-"), k)
        robots = (
            F.when(k % 5 == 0, F.concat(F.lit("User-agent: *\nDisallow: /private\nSitemap: "), url))
            .when(k % 5 == 1, F.lit("User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nAllow: /\n# note\nfoo bar"))
            .when(k % 5 == 2, F.lit("User-agent: *\nDisallow: /"))
            .when(k % 5 == 3, F.lit("Disallow: /a\nnonsense\nUser-agent: ClaudeBot\nAllow: /\nDisallow: /x # why\nUser-agent: claudebot\nDisallow: /"))
            .otherwise(F.lit(" "))
        )
        entry = F.concat(F.lit("<url><loc>"), url, F.lit("</loc>"), F.when(k % 2 == 0, F.lit("<lastmod>2024-01-01</lastmod>")).otherwise(F.lit("")), F.lit("</url>"))
        sitemap = F.concat(
            F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.repeat(entry, (k % 14).cast("int")), F.when(k % 9 != 0, F.lit("</urlset>")).otherwise(F.lit("")),
        )
        llms = F.concat(
            F.lit("# Site "), k, F.lit("\n"), F.when(k % 3 == 0, F.lit("> About the site\n")).otherwise(F.lit("")),
            F.lit("## Links\n"), F.when(k % 4 != 0, F.concat(F.lit("- [Home]("), url, F.lit("): start page\n- [Other](/o)\n"))).otherwise(F.lit("")),
            F.when(k % 2 == 0, F.repeat(F.lit("More words about this. "), 10)).otherwise(F.lit("<br >")),
        )
        agents = F.concat(
            F.lit("# Rules "), k, F.lit("\n"), F.when(k % 2 == 0, F.lit("## Supported bots\n- action: read\n")).otherwise(F.lit("## General\n")),
            F.when(k % 3 == 0, F.lit("Contact: me@example.com\n")).otherwise(F.lit("")), F.repeat(F.lit("text "), (k % 60).cast("int")),
        )
        mcp = (
            F.when(k % 4 == 0, F.concat(F.lit('{"mcpServers":{"a":{"url":"'), url, F.lit('","transport":"sse","description":"d"},"b":{"transport":"pipe"}}}')))
            .when(k % 4 == 1, F.lit('{"mcpServers":[]}'))
            .when(k % 4 == 2, F.lit("{bad"))
            .otherwise(F.concat(F.lit('{"mcpServers":{"a":{"url":"'), url, F.lit('","transport":"http","description":" "}}}')))
        )
        file = lambda path, content, status: F.struct(
            F.lit(path).alias("path"), content.alias("content"), status.cast("int").alias("status_code"))
        files = F.array(
            file("/robots.txt", robots, F.when(k % 11 == 0, 404).otherwise(200)),
            file("/sitemap.xml", sitemap, F.when(k % 13 == 0, 500).otherwise(200)),
            file("/llms.txt", llms, F.when(k % 7 == 0, 404).otherwise(200)),
            file("/llms-full.txt", F.concat(F.lit("# Full "), k), F.lit(200)),
            file("/agents.md", F.when(k % 10 == 0, F.lit("<html>not found</html>")).otherwise(agents), F.lit(200)),
            file("/.well-known/mcp.json", mcp, F.lit(200)),
        )
        return self.raw("pages").select(site.alias("site"), F.explode(files).alias("f")).select("site", "f.*")

    # --- AI answers ---------------------------------------------------------------------------------

    def answers(self, conversations: DataFrame | None = None) -> DataFrame:
        """Assistant turns as AI answers: lists by conversation, and a citation of a page in one of four forms."""
        source = spread(self.raw("conversations") if conversations is None else conversations)
        p = self.raw("pages")
        n = p.agg(F.count(F.lit(1)).alias("n"))
        turns = source.filter(C("role") == "assistant").crossJoin(F.broadcast(n))
        a = turns.withColumn("page_id", (C("conv_id") * 7 + C("turn")) % C("n"))
        a = a.join(p.select("page_id", C("url")), "page_id")
        k = C("conv_id")
        t = C("text")
        listed = (
            F.when(k % 5 == 0, F.concat(F.lit("Top 5 options\n1. "), F.replace(t, F.lit("\n"), F.lit("\n1. "))))
            .when(k % 5 == 1, F.concat(F.lit("- "), F.replace(t, F.lit("\n"), F.lit("\n- "))))
            .when(k % 5 == 2, F.concat(F.lit("## "), F.replace(t, F.lit("\n"), F.lit("\n## "))))
            .otherwise(t)
        )
        cite = (
            F.when(k % 4 == 1, F.concat(F.lit(" [src]("), C("url"), F.lit(")")))
            .when(k % 4 == 2, F.concat(F.lit(" <"), C("url"), F.lit(">")))
            .when(k % 4 == 3, F.concat(F.lit(" [1]: "), C("url"), F.lit(".")))
            .when(C("turn") % 4 == 1, F.lit(" according to experts this is the best choice"))
            .otherwise(F.concat(F.lit(" see "), C("url"), F.lit(", a poor page")))
        )
        engine = F.element_at(F.array(*[F.lit(e) for e in ("chatgpt", "claude", "perplexity", "gemini")]), (k % 4 + 1).cast("int"))
        model = F.element_at(
            F.array(*[F.lit(m) for m in ("gpt-4o", "claude-sonnet-4-20250514", "sonar", "gemini-2.0-flash", "in-house")]),
            (k % 5 + 1).cast("int"),
        )
        start = F.lit("2024-01-01").cast("timestamp")
        at = F.timestamp_seconds(F.unix_timestamp(start) + (k % 30) * 86400 + C("turn") * 3600)
        return a.select(
            (k * 1000 + C("turn")).alias("snapshot_id"), (k % 10).alias("project_id"), engine.alias("ai_engine"),
            F.concat(F.lit("q"), k % 25).alias("query_text"), at.alias("queried_at"), model.alias("model"),
            (F.length(t) + 20).cast("long").alias("input_tokens"), (F.length(t) * 3).cast("long").alias("output_tokens"),
            F.concat(listed, cite).alias("text"),
        )

    def projects(self) -> DataFrame:
        return self.raw("conversations").select((C("conv_id") % 10).alias("project_id")).distinct()

    def brand_names(self) -> DataFrame:
        k = C("project_id")
        names = (
            F.when(k % 3 == 0, F.array(F.lit("that"), F.lit("is"))).when(k % 3 == 1, F.array(F.lit("des"), F.lit("une")))
            .otherwise(F.array(F.lit("und"), F.lit("the")))
        )
        return self.projects().select(
            "project_id", F.concat(F.lit("brand"), k).alias("brand"), F.explode(names).alias("name"))

    def brand_domains(self) -> DataFrame:
        """Own domain of a project: the first host among its share of the pages."""
        k = C("page_id") % 10
        return self.raw("pages").groupBy(k.alias("project_id")).agg(F.min(urls.bare_host(C("url"))).alias("domain"))

    def competitors(self) -> DataFrame:
        words = F.array(F.lit("for"), F.lit("der"), F.lit("les"), F.lit("of"))
        return self.projects().select("project_id", F.explode(words).alias("keyword"))

    def client_pages(self) -> DataFrame:
        """Known pages with variants that give exact, path, fuzzy and no matches."""
        k, url = C("page_id"), C("url")
        changed = (
            F.when(k % 4 == 0, url)
            .when(k % 4 == 1, F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("?v=1")))
            .when(k % 4 == 2, F.concat(F.regexp_replace(url, r"/?([?#].*)?$", ""), F.lit("x")))
            .otherwise(F.concat(F.lit("https://elsewhere.example/p/"), k))
        )
        return self.raw("pages").select(k.alias("client_page_id"), changed.alias("url"), k.alias("candidate_order"))

    # --- stored facts ---------------------------------------------------------------------------------

    def mentions(self) -> DataFrame:
        v = C("value")
        sentiment = F.when(v < 150, "negative").when(v < 300, "neutral").otherwise("positive")
        kind = F.when(C("event_type") == "click", "recommendation").when(C("event_type") == "view", "comparison").when(
            C("event_type") == "signup", "citation").otherwise("passing")
        return self.raw("events").select(
            C("event_id").alias("mention_id"), ((C("event_id") % 150) * 1000 + 1).alias("snapshot_id"),
            (C("user_id") % 10).alias("project_id"), F.concat(F.lit("brand"), C("user_id") % 7).alias("brand_name"),
            kind.alias("mention_type"), (C("event_id") % 97).cast("int").alias("position"),
            sentiment.alias("sentiment"), (C("event_id") % 11 == 0).alias("sentiment_override"),
            C("ts").alias("mentioned_at"),
        )

    def rankings(self) -> DataFrame:
        """One row per (order, part, supplier, line): repeated keys of the source are merged first."""
        keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
        line = self.raw("lineitem").groupBy(*keys).agg(
            F.max("l_quantity").alias("q"), F.max("l_shipdate").alias("t"))
        n = C("l_linenumber")
        engine = F.element_at(F.array(*[F.lit(e) for e in ("chatgpt", "claude", "perplexity", "gemini")]), (n % 4 + 1).cast("int"))
        return line.select(
            C("l_orderkey").alias("snapshot_id"), (C("l_orderkey") * 100_000 + C("l_partkey") * 10 + n).alias("ranking_id"),
            (C("l_suppkey") % 10).alias("project_id"), F.concat(F.lit("brand"), C("l_suppkey") % 3).alias("brand_name"),
            F.when(C("l_partkey") % 3 != 0, F.concat(F.lit("comp"), C("l_partkey") % 3)).alias("competitor_name"),
            engine.alias("ai_engine"), (C("q").cast("int") % 10 + 1).alias("rank_position"), C("t").alias("ranked_at"),
        )

    def check_results(self) -> DataFrame:
        """Check scores from order lines; two part parities cover the 14 checks."""
        index = (C("l_linenumber") - 1) + 7 * (C("l_partkey") % 2)
        ids = F.array(*[F.lit(c) for c in K.CHECK_IDS])
        rows = self.raw("lineitem").filter(C("l_linenumber").between(1, 7)).select(
            C("l_orderkey").alias("scan_id"), F.element_at(ids, (index + 1).cast("int")).alias("check_id"),
            "l_quantity", "l_discount",
        )
        score = (F.max("l_quantity") * 2).cast("int")
        return rows.groupBy("scan_id", "check_id").agg(
            score.alias("score"),
            F.when(F.max("l_discount") >= 0.1, "error").when(score < 40, "fail").when(score < 80, "warn").otherwise("pass").alias("status"),
        )

    def scans(self) -> DataFrame:
        k = C("o_orderkey")
        locale = F.element_at(F.array(*[F.lit(x) for x in ("de-DE", "en-US", "fr-FR", "es-ES")]), (k % 4 + 1).cast("int"))
        score = (F.floor("o_totalprice") % 101).cast("int")
        return self.raw("orders").select(
            k.alias("scan_id"), C("o_custkey").alias("user_id"), F.concat(F.lit("site"), C("o_custkey") % 200, F.lit(".example")).alias("domain"),
            C("o_orderdate").alias("scanned_at"), score.alias("score"),
            F.when(C("o_orderstatus") == "F", "completed").when(C("o_orderstatus") == "O", "processing").otherwise("pending").alias("status"),
            locale.alias("locale"), (k % 10 == 0).alias("is_deleted"),
        )

    def score_snapshots(self) -> DataFrame:
        k, price = C("o_orderkey"), F.floor("o_totalprice")
        return self.raw("orders").select(
            k.alias("snapshot_id"), (C("o_custkey") % 50).alias("project_id"), (price % 101).cast("int").alias("overall_score"),
            (price % 4).cast("int").alias("readiness_level"),
            (price % 97).cast("int").alias("readability"), F.when(k % 3 != 0, (price % 89).cast("int")).alias("interactivity"),
            F.when(k % 5 == 0, (price % 83).cast("int")).alias("transactional"), (k % 37).cast("int").alias("citations"),
            F.when(k % 9 == 0, "baseline").otherwise("scheduled").alias("snapshot_type"), C("o_orderdate").alias("created_at"),
        )

    # --- citations ------------------------------------------------------------------------------------

    def citations(self) -> DataFrame:
        k = C("o_orderkey")
        model = F.element_at(F.array(*[F.lit(m) for m in ("chatgpt", "claude", "perplexity", "gemini")]), (C("o_custkey") % 4 + 1).cast("int"))
        return self.raw("orders").select(
            k.alias("citation_id"), (C("o_custkey") % 100).alias("audit_id"), model.alias("model_name"),
            F.concat(F.lit("q"), C("o_custkey") % 40).alias("query_text"), C("o_orderdate").alias("extracted_at"),
        )

    def audits(self) -> DataFrame:
        """Audits of the citation tables: 100 ids, five users."""
        return self.raw("orders").select((C("o_custkey") % 100).alias("audit_id")).distinct().select(
            "audit_id", (C("audit_id") % 5).alias("user_id"), (C("audit_id") % 10).alias("project_id"))

    def cited_pages(self) -> DataFrame:
        return self.raw("pages").select(
            C("page_id").alias("cited_page_id"), "url", urls.bare_host(C("url")).alias("domain"),
            F.when(C("page_id") % 3 != 0, C("page_id") % 50).alias("client_page_id"),
        )

    def mappings(self) -> DataFrame:
        """Each citation is mapped to one page; every fourth citation stays unmapped."""
        n = self.raw("pages").agg(F.count(F.lit(1)).alias("n"))
        k = C("o_orderkey")
        kind = F.element_at(F.array(*[F.lit(m) for m in ("exact", "path", "fuzzy", "unmatched")]), (k % 4 + 1).cast("int"))
        return self.raw("orders").crossJoin(F.broadcast(n)).filter(k % 4 != 3).select(
            k.alias("citation_id"), (k % C("n")).alias("cited_page_id"), (k % 10).cast("int").alias("position"), kind.alias("match_type"))

    def earlier_mappings(self) -> DataFrame:
        """The mappings of earlier runs: all of some (audit, model, query) triples are still to come."""
        return self.raw("orders").filter((C("o_orderkey") % 4 != 3) & (C("o_custkey") % 200 % 9 != 0)).select(C("o_orderkey").alias("citation_id"))

    def source_attributions(self) -> DataFrame:
        """Attributed sources of mentions."""
        n = self.raw("pages").agg(F.count(F.lit(1)).alias("n"))
        k = C("event_id")
        return self.raw("events").crossJoin(F.broadcast(n)).withColumn("page_id", k % C("n")).join(
            self.raw("pages").select("page_id", "url"), "page_id"
        ).select(
            k.alias("attribution_id"), k.alias("mention_id"), (C("user_id") % 10).alias("project_id"), "url",
            urls.bare_host(C("url")).alias("domain"), (C("page_id") % 4 == 0).alias("is_own_domain"),
            F.when(C("page_id") % 4 == 0, C("page_id")).alias("matched_page_id"),
            F.when(k % 8 == 0, "unstructured").otherwise("structured").alias("source_type"),
        )

    # --- events, jobs ----------------------------------------------------------------------------------

    def conversion_events(self) -> DataFrame:
        return self.raw("events").select(
            C("event_id").alias("request_id"), "event_type", C("props").alias("metadata"), C("ts").alias("created_at"), "user_id")

    def job_log(self) -> DataFrame:
        e = C("event_type")
        state = F.when(e == "click", "waiting").when(e == "view", "active").when(e == "purchase", "completed").when(
            e == "signup", "delayed").otherwise("failed")
        return self.raw("events").select(
            F.concat(F.lit("queue"), C("user_id") % 5).alias("queue"), C("event_id").alias("job_id"), state.alias("state"), "ts")

    def deliveries(self) -> DataFrame:
        """Webhook delivery attempts: several events of one user form the attempts of a delivery."""
        return self.raw("events").select(
            C("user_id").alias("delivery_id"), C("event_id").alias("attempt_id"), C("ts").alias("attempted_at"),
            F.when(C("event_type") == "error", 500).when(C("event_type") == "view", 404).otherwise(200).alias("http_status"),
        )

    # --- posts -----------------------------------------------------------------------------------------

    def posts(self) -> DataFrame:
        return self.raw("conversations").filter(C("turn") == 0).select(
            F.concat(F.lit("p"), C("conv_id")).alias("reddit_id"), F.concat(F.lit("sub"), C("conv_id") % 6).alias("subreddit"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), C("text").alias("body"), (C("conv_id") % 90).cast("int").alias("score"),
        )

    def comments(self) -> DataFrame:
        return self.raw("conversations").filter(C("turn") > 0).select(
            F.concat(F.lit("c"), C("conv_id"), F.lit("x"), C("turn")).alias("reddit_id"),
            F.concat(F.lit("p"), C("conv_id")).alias("post_id"), C("text").alias("body"),
            (C("conv_id") % 40 + C("turn")).cast("int").alias("score"),
        )

    def brand_links(self) -> DataFrame:
        """Stored links of brands to posts and comments."""
        sentiment = F.element_at(F.array(F.lit("positive"), F.lit("neutral"), F.lit("negative")), ((C("conv_id") + C("turn")) % 3 + 1).cast("int"))
        return self.raw("conversations").select(
            F.when(C("turn") == 0, "post").otherwise("comment").alias("mention_type"),
            F.when(C("turn") == 0, F.concat(F.lit("p"), C("conv_id"))).otherwise(F.concat(F.lit("c"), C("conv_id"), F.lit("x"), C("turn"))).alias("mention_id"),
            (C("conv_id") % 4).alias("brand_id"), F.lit("kw").alias("keyword"), sentiment.alias("sentiment"),
            (C("conv_id") * 1000 + C("turn")).alias("link_id"),
        )

    def ai_links(self) -> DataFrame:
        """Posts and comments that AI answers cite."""
        return self.brand_links().filter(C("link_id") % 7 == 1).select("mention_type", "mention_id", C("link_id").alias("citation_id"))

    def reddit_answers(self) -> DataFrame:
        """Answers with links to posts and comments, known and unknown ones."""
        k, t = C("conv_id"), C("turn")
        link = F.concat(F.lit("https://"), F.when(t % 3 == 0, "www.").when(t % 3 == 1, "old.").otherwise(""),
                        F.lit("reddit.com/r/Sub"), k % 6, F.lit("/comments/p"), k, F.lit("/slug"))
        text = F.concat(C("text"), F.lit(" ("), link, F.lit(") "), link, F.lit("/c"), k, F.lit("x"), t * 2,
                        F.lit(" https://reddit.com/r/x/comments/zz"), k)
        return self.raw("conversations").filter(C("role") == "assistant").select((k * 1000 + t).alias("citation_id"), text.alias("raw_response"))

    # --- business ---------------------------------------------------------------------------------------

    def invoices(self) -> DataFrame:
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        k = C("o_orderkey")
        return self.raw("orders").crossJoin(F.broadcast(n)).select(
            k.alias("invoice_id"), (C("o_custkey") % C("n")).alias("affiliate_id"), C("o_custkey").alias("user_id"),
            (F.round(C("o_totalprice") * 100)).cast("long").alias("net_cents"), C("o_orderdate").alias("paid_at"),
            F.when(k % 50 == 0, (k % 12000)).alias("custom_rate_bps"), (k % 13 != 0).alias("has_payment"),
        )

    def affiliates(self) -> DataFrame:
        return self.raw("supplier").select(
            C("s_suppkey").alias("affiliate_id"), (C("s_suppkey") * 3).alias("user_id"),
            F.concat(F.lit("owner"), C("s_suppkey"), F.lit("@mail"), C("s_suppkey") % 20, F.lit(".example")).alias("email"),
            F.when(C("s_suppkey") % 9 == 0, "suspended").otherwise("active").alias("status"),
        )

    def conversions(self) -> DataFrame:
        """Conversions of affiliates: one per order, dated by it; every sixth churns within a day."""
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        k = C("o_orderkey")
        return self.raw("orders").crossJoin(F.broadcast(n)).select(
            k.alias("conversion_id"), (C("o_custkey") % C("n")).alias("affiliate_id"), C("o_custkey").alias("referred_user_id"),
            F.concat(F.lit("u"), C("o_custkey"), F.lit("@mail"), C("o_custkey") % 400, F.lit(".example")).alias("email"),
            C("o_orderdate").alias("converted_at"),
            F.when(k % 6 == 0, F.date_add(C("o_orderdate"), 1).cast("timestamp")).alias("churned_at"),
        )

    def clicks(self) -> DataFrame:
        """Referral clicks: order lines by supplier and ship date, the affiliates of low keys being busy."""
        return self.raw("lineitem").select(
            (C("l_suppkey") % 5).alias("affiliate_id"), C("l_shipdate").alias("clicked_at"))
