"""Fixed values that results depend on.

These are data, not logic: weights, id sets, word lists, price tables and limits. They are stated
in plain text and natural order so that they can be checked against the product definition.
"""

# --- checks: id -> (category, severity, weight) -------------------------------------------------
CHECKS = {
    "robots-txt": ("readability", "critical", 13),
    "sitemap-xml": ("readability", "important", 7),
    "llms-txt": ("readability", "critical", 7),
    "schema-org": ("readability", "important", 10),
    "content-structure": ("readability", "important", 10),
    "semantic-quality": ("readability", "important", 10),
    "citation-readiness": ("readability", "important", 8),
    "content-freshness": ("readability", "important", 5),
    "faq-schema": ("readability", "important", 5),
    "meta-tags": ("readability", "important", 11),
    "js-rendering": ("readability", "critical", 11),
    "performance": ("readability", "nice-to-have", 3),
    "webmcp": ("interactivity", "nice-to-have", 0),
    "agents-md": ("interactivity", "nice-to-have", 0),
}
CHECK_IDS = tuple(CHECKS)
CATEGORIES = ("readability", "interactivity", "transactional")
FUTURE_CHECKS = ("llms-txt", "webmcp", "agents-md")
CURRENT_CHECKS = tuple(c for c in CHECK_IDS if c not in FUTURE_CHECKS)
PUBLIC_AUDIT_CHECKS = (
    "robots-txt", "llms-txt", "agents-md", "meta-tags", "schema-org", "sitemap-xml", "content-structure",
)
LEVEL_GATES = {
    1: ("robots-txt",),
    2: ("robots-txt", "meta-tags"),
    3: ("robots-txt", "meta-tags", "llms-txt", "schema-org", "content-structure"),
}
LEVEL_CEILINGS = ((20, 0), (50, 1), (75, 2))  # score up to -> level, else 3
GATE_PASS = 50
FAIL_BELOW, PASS_FROM = 40, 80

# --- side files ----------------------------------------------------------------------------------
SIDE_PATHS = (
    "/robots.txt", "/sitemap.xml", "/llms.txt", "/llms-full.txt",
    "/.well-known/agents.md", "/agents.md", "/.well-known/mcp.json",
)
PRIMARY_BOTS = ("GPTBot", "ChatGPT-User", "ClaudeBot", "Claude-Web", "PerplexityBot", "Google-Extended")
SECONDARY_BOTS = ("Googlebot", "Bingbot")
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MCP_TRANSPORTS = ("sse", "http", "streamable-http")
MCP_MAX_CHARS = 1_048_576

# --- structured data -----------------------------------------------------------------------------
PRIMARY_TYPES = (
    "Organization", "WebSite", "Article", "NewsArticle", "BlogPosting", "Product", "FAQPage", "LocalBusiness",
)
SECONDARY_TYPES = ("BreadcrumbList", "WebPage", "Person", "HowTo", "Event", "Service")
REQUIRED_PROPERTIES = {
    "Organization": ("name", "url"),
    "WebSite": ("name", "url"),
    "Article": ("headline",),
    "NewsArticle": ("headline",),
    "BlogPosting": ("headline",),
    "Product": ("name",),
    "FAQPage": ("mainEntity",),
    "BreadcrumbList": ("itemListElement",),
    "LocalBusiness": ("name", "address"),
    "HowTo": ("name", "step"),
    "Event": ("name", "startDate"),
    "Person": ("name",),
    "Service": ("name",),
    "WebPage": ("name",),
}
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting")
ARTICLE_FIELDS = (
    "headline", "author", "datePublished", "dateModified",
    "description", "image", "publisher", "mainEntityOfPage",
)
ARTICLE_OG_PROPERTIES = (
    "article:published_time", "article:modified_time", "article:author", "article:section", "article:tag",
)

# --- rendering -----------------------------------------------------------------------------------
FRAMEWORKS = (
    ("Next.js", r"(?i)__NEXT_DATA__|_next/static|data-nscript"),
    ("Nuxt", r"(?i)__NUXT__|__NUXT_DATA__|_nuxt/"),
    ("Astro", r"(?i)data-astro-cid-|astro-island"),
    ("Gatsby", r"(?i)___gatsby|gatsby-"),
    ("Remix", r"(?i)__remixManifest|data-remix"),
    ("SvelteKit", r"(?i)__sveltekit_|svelte-"),
    ("Angular Universal", r"(?i)ng-version|_nghost-|_ngcontent-"),
)
SPA_ROOT_IDS = ("root", "app", "__next", "__nuxt", "__vue_app", "___gatsby")

# --- language ------------------------------------------------------------------------------------
STOPWORDS_DE = (
    "der", "die", "das", "und", "in", "ist", "von", "den", "mit", "auf", "für", "ein", "eine", "einer",
    "einem", "einen", "eines", "nicht", "sich", "auch", "es", "an", "zu", "aus", "bei", "nach", "durch",
    "vor", "wie", "noch", "über", "oder", "aber", "dem", "werden", "wird", "hat", "haben", "sind", "war",
    "kann", "nur", "so", "sehr", "mehr", "wenn", "als", "man", "was", "ich", "wir", "sie", "er",
)
STOPWORDS_EN = (
    "the", "and", "for", "are", "was", "not", "you", "all", "can", "had", "her", "one", "our", "out",
    "has", "its", "this", "that", "with", "from", "have", "been", "will", "your", "which", "their",
)
STOPWORDS = STOPWORDS_DE + STOPWORDS_EN

RECOMMENDATION_PHRASES = (
    "recommend", "empfehl", "should use", "best choice", "top pick", "go with", "suggest", "vorschlag",
    "ideal for", "am besten", "highly rated", "erste wahl",
)
COMPARISON_PHRASES = (
    "compared to", " vs ", " vs.", "versus", "im vergleich", "better than", "worse than", "alternative to",
    "unlike", "im gegensatz", "instead of", "anstatt", "gegenüber",
)
CITATION_PHRASES = (
    "according to", "laut", "source:", "reports that", "states that", "published by", "data from",
    "research by", "studie von", "berichtet",
)
POSITIVE_WORDS = (
    "excellent", "great", "best", "outstanding", "superior", "reliable", "innovative", "empfehlenswert",
    "hervorragend", "zuverlässig", "top", "leading", "strong", "powerful", "impressive", "trusted", "preferred",
)
NEGATIVE_WORDS = (
    "poor", "bad", "worst", "unreliable", "lacking", "disappointing", "schlecht", "mangelhaft", "schwach",
    "problematic", "fails", "inferior", "limited", "overpriced", "avoid", "vermeiden",
)
UNSTRUCTURED_MARKERS = (
    "laut experten", "laut studien", "according to experts", "according to studies",
    "experts say", "studies show", "research shows", "research indicates",
)
MATCH_PRIORITY = {"exact": 3, "fuzzy": 2, "contextual": 1}

# --- mention extraction defaults -----------------------------------------------------------------
FUZZY_FLOOR = 0.85
FUZZY_FLOOR_MEDIUM = 0.88
MIN_CONFIDENCE = 0.7
DEDUPE_RADIUS = 20
CONTEXT_CHARS = 150
MIN_LIST_ITEMS = 3

# --- URLs ----------------------------------------------------------------------------------------
TRACKING_KEYS_STRICT = (
    r"(?i)^(utm_.*|fbclid|gclid|gclsrc|dclid|msclkid|mc_cid|mc_eid|_ga|_gl|yclid|ref|ref_src|ref_url"
    r"|igshid|hsCtaTracking)$"
)
TRACKING_KEYS_PREFIX = r"(?i)^(utm_|fbclid|gclid|mc_cid|mc_eid|ref|ref_|_hsenc|_hsmi|msclkid)"
REJECT_SCHEMES = ("javascript:", "mailto:", "tel:", "data:", "blob:")

# --- prices: USD per million tokens (input, output) ----------------------------------------------
MODEL_PRICES = (
    ("claude-haiku-4-5-20251001", "0.80", "4.00"),
    ("claude-sonnet-4-20250514", "3.00", "15.00"),
    ("claude-opus-4-20250514", "15.00", "75.00"),
    ("gpt-4o-mini", "0.15", "0.60"),
    ("gpt-4o", "2.50", "10.00"),
    ("sonar", "1.00", "1.00"),
    ("sonar-pro", "3.00", "15.00"),
    ("gemini-2.0-flash", "0.10", "0.40"),
    ("gemini-2.5-pro-preview-05-06", "1.25", "10.00"),
)

# --- plans: name, order, scans/month, scans/day, fixes/month, prompts/month, guarantee -------------
# None means unlimited.
PLANS = (
    ("free", 0, 3, 1, 0, 0, False),
    ("starter", 1, 50, 10, 10, 0, False),
    ("pro", 2, None, None, None, 25, True),
    ("agency", 3, None, None, None, 100, True),
    ("enterprise", 4, None, None, None, None, True),
)

# --- referral and guarantee ----------------------------------------------------------------------
COMMISSION_TIERS = ((0, 2000), (10, 2500), (50, 3000))  # prior commissions from -> basis points
MIN_PAYOUT_CENTS = 5000
OPEN_PAYOUT_STATES = ("requested", "approved", "processing")
PAYOUT_TRANSITIONS = (
    ("requested", "approved"), ("requested", "failed"), ("approved", "processing"), ("approved", "failed"),
    ("processing", "completed"), ("processing", "failed"),
)
DEPLOYMENT_TRANSITIONS = (
    ("pending", "in_progress"), ("pending", "failed"), ("in_progress", "succeeded"), ("in_progress", "failed"),
    ("succeeded", "rolled_back"), ("succeeded", "failed"),
)
FRAUD = {
    "clicks_per_day": 500, "conversion_ratio": 0.005, "churn_rate": 0.3, "churn_min_sample": 10,
    "conversions_per_day": 20, "suspend_flags": 3,
}
GUARANTEE_DAYS = (30, 60, 90)
DACH = ("DE", "AT", "CH")

# --- milestones and alerts -----------------------------------------------------------------------
SCORE_THRESHOLDS = (25, 50, 75, 90)
IMPROVEMENT_MIN_PERCENT = 20
IMPROVEMENT_WINDOW_DAYS = 30
ALERT_COOLDOWN_MINUTES = 360
TREND_BAND = 0.05
SERVICE_RULES = (
    # rule, metric, threshold, severity, fires at threshold itself
    ("webhook_failure_rate_high", "webhook_failure_rate", 0.2, "critical", False),
    ("api_error_rate_high", "api_error_rate", 0.05, "warning", False),
    ("csv_queue_backlog", "csv_queued", 100.0, "warning", False),
    ("looker_auth_failures", "auth_failures", 1.0, "warning", True),
)

# --- rate limits: requests per 60 s by endpoint group and plan -------------------------------------
RATE_LIMITS = {
    "scan": {"anonymous": 5, "free": 10, "starter": 30, "pro": 60, "agency": 150, "enterprise": 300},
    "mutation": {"anonymous": 0, "free": 5, "starter": 15, "pro": 30, "agency": 60, "enterprise": 150},
    "status": {"anonymous": 60, "free": 60, "starter": 120, "pro": 300, "agency": 600, "enterprise": 1500},
    "billing": {"anonymous": 0, "free": 5, "starter": 5, "pro": 5, "agency": 5, "enterprise": 5},
    "public": {"anonymous": 5, "free": 5, "starter": 5, "pro": 5, "agency": 5, "enterprise": 5},
    "cms": {"anonymous": 0, "free": 0, "starter": 0, "pro": 10, "agency": 30, "enterprise": 60},
}

# --- retention -----------------------------------------------------------------------------------
PLAN_RETENTION_DAYS = {"free": 30, "starter": 90, "pro": 180, "agency": 365, "enterprise": 730}
HTML_RETENTION_HOURS = 72
DEAD_LETTER_DAYS = 30
SCORE_HISTORY_DAYS = 52 * 7

# --- BI extract: field id -> (kind, data type, source, default aggregation, on by default) ----------
BI_FIELDS = {
    "scan_id": ("DIMENSION", "STRING", "scans", None, False),
    "domain": ("DIMENSION", "STRING", "scans", None, True),
    "scan_date": ("DIMENSION", "DATE", "scans", None, True),
    "locale_country": ("DIMENSION", "STRING", "locales", None, False),
    "locale_language": ("DIMENSION", "STRING", "locales", None, False),
    "competitor_domain": ("DIMENSION", "STRING", "competitors", None, False),
    "status": ("DIMENSION", "STRING", "scans", None, False),
    "readiness_score": ("METRIC", "NUMBER", "scans", "AVG", True),
    "readiness_level": ("METRIC", "NUMBER", "scans", "AVG", False),
    "citation_count": ("METRIC", "NUMBER", "citations", "COUNT", True),
    "fix_count": ("METRIC", "NUMBER", "fixes", "COUNT", False),
    "competitor_count": ("METRIC", "NUMBER", "competitors", "COUNT", False),
    "locale_count": ("METRIC", "NUMBER", "domain_locales", "COUNT", False),
}
