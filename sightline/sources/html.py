"""One pass over the HTML of a page, as an Arrow job.

Built-in functions cannot follow element nesting, so a short tokenizer runs inside ``mapInArrow`` and
emits one typed row of facts per page. Every rubric is then a native expression over these facts. Word and
sentence counts are taken in the same pass: as array expressions over the extracted text they cost four times
the pass itself (measured), and the text would have to travel back through Arrow.

Rules for broken markup: an end tag closes everything up to its start tag and is ignored without one;
a block element closes an open ``p``; ``li``, ``td``, ``tr``, ``dt``/``dd`` and ``option`` close an
open sibling; ``script``, ``style`` and ``noscript`` hold raw text up to their end tag; comments and
declarations are skipped; an element left open ends with the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.constants import SPA_ROOT_IDS, STOPWORDS

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][\w:.-]*)"
    r"(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+|[^>]*)>",
    re.S,
)
ATTR = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[^\sa-zA-ZäöüÄÖÜß]*[a-zA-ZäöüÄÖÜß]\S*")
NUMBER = re.compile(r"\b\d[\d.,]*\b", re.A)
SENTENCE_END = re.compile(r"[.!?]+")
STOP = frozenset(STOPWORDS)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript"))
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)
SIBLINGS = {
    "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
    "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
}
SCOPE = {
    "li": ("ul", "ol"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",),
    "option": ("select",), "p": ("td", "th", "li", "button", "table"),
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CHROME = ("nav", "header", "footer")
COUNTED = (
    "main", "article", "section", "nav", "header", "footer", "p", "ul", "ol", "blockquote", "cite", "time",
    "dfn", "h1", "noscript",
)

FACTS_DDL = (
    "error STRING, title_count INT, title STRING, meta_names MAP<STRING,STRING>, meta_properties MAP<STRING,STRING>, "
    "description_count INT, charset STRING, canonical STRING, lang STRING, "
    "headings ARRAY<STRUCT<level: INT, text: STRING>>, tag_counts MAP<STRING,INT>, node_count INT, "
    "paragraphs ARRAY<STRUCT<chars: INT, words: INT>>, first_p_index INT, first_p_in_content BOOLEAN, "
    "text_chars LONG, visible_bytes LONG, word_count INT, body_words INT, content_words INT, plain_words INT, "
    "distinct_words INT, top_word_count INT, long_words INT, sentence_words ARRAY<INT>, sentence_count INT, "
    "question_count INT, number_count INT, visible_numbers INT, body_text STRING, "
    "content_links ARRAY<STRING>, external_scripts INT, inline_script_chars LONG, large_inline_blocks INT, "
    "noscript_chars LONG, json_ld ARRAY<STRING>, time_values ARRAY<STRING>, rel_author BOOLEAN, byline BOOLEAN, "
    "figure_with_caption BOOLEAN, spa_root STRING"
)


def _attrs(text: str) -> dict:
    out: dict = {}
    for name, a, b, c in ATTR.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _join(parts: list) -> str:
    text = "".join(parts)
    return unescape(text) if "&" in text else text


def _words(text: str) -> list:
    """Lower-case words of two or more characters with at least one letter."""
    return [w for w in WORD.findall(text.lower()) if len(w) > 1]


def _text_stats(content: str) -> dict:
    words = _words(content)
    plain = Counter(w for w in words if w not in STOP)
    sentences = [t for t in (s.strip() for s in SENTENCE_END.split(content)) if len(t) > 10]
    return {
        "content_words": len(words), "long_words": sum(len(w) >= 10 for w in words),
        "plain_words": plain.total(), "distinct_words": len(plain), "top_word_count": max(plain.values(), default=0),
        "sentence_words": [n for n in (len(_words(t)) for t in sentences) if n], "sentence_count": len(sentences),
        "question_count": content.count("?"),
    }


def page_facts(html: str) -> dict:
    """Facts of one page; see ``FACTS_DDL`` for the fields."""
    counts: dict = {}
    names: dict = {}
    props: dict = {}
    f = {
        "title_count": 0, "title": None, "description_count": 0, "charset": None, "canonical": None, "lang": None,
        "rel_author": False, "byline": False, "figure_with_caption": False, "external_scripts": 0,
        "inline_script_chars": 0, "large_inline_blocks": 0, "noscript_chars": 0,
    }
    http_equiv = None
    nodes = raw_chars = chrome = 0
    in_body = body_seen = False
    head, body, plain = [], [], []
    scopes: dict = {}  # 'main' / 'article' -> [text parts, links] of the first one
    body_links: list = []
    open_scopes: list = []
    headings, paragraphs, spa, json_ld, times = [], [], {}, [], []
    stack: list = []  # (name, text collector or None)
    collectors: list = []  # stack depth and parts of headings, paragraphs, titles and roots still open

    def close_to(depth: int) -> None:
        nonlocal chrome
        while len(stack) > depth:
            name = stack.pop()
            chrome -= name in CHROME
            while collectors and collectors[-1][0] > len(stack):
                collectors.pop()
            while open_scopes and open_scopes[-1][0] > len(stack):
                open_scopes.pop()

    def add_text(text: str) -> None:
        if not text:
            return
        (body if in_body or not stack or stack[0] != "html" else head).append(text)
        if not chrome:
            plain.append(text)
        for _, parts in collectors:
            parts.append(text)
        for _, key in open_scopes:
            scopes[key][0].append(text)

    pos = 0
    for m in TAG.finditer(html):
        if m.start() < pos:
            continue  # inside raw text already consumed
        add_text(html[pos : m.start()])
        pos = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if m.group("end"):
            if name in stack:
                close_to(len(stack) - 1 - stack[::-1].index(name))
            continue
        attrs = _attrs(m.group("attrs"))
        nodes += 1
        counts[name] = counts.get(name, 0) + 1

        closes = ("p",) if name in BLOCKS else SIBLINGS.get(name, ())
        barrier = SCOPE["p"] if name in BLOCKS else SCOPE.get(name, ())
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth] in closes:
                close_to(depth)
                if name != "tr":
                    break
            elif stack[depth] in barrier:
                break

        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, pos)
            text = html[pos : end.start() if end else len(html)]
            pos = end.end() if end else len(html)
            raw_chars += len(text)
            kind = attrs.get("type")
            if name == "noscript":
                f["noscript_chars"] += len(text.strip())
            elif name == "script" and kind == "application/ld+json":
                json_ld.append(text.strip())
            if name == "script":
                if attrs.get("src"):
                    f["external_scripts"] += 1
                elif kind not in ("application/ld+json", "application/json"):
                    f["inline_script_chars"] += len(text)
            if name == "style" or (name == "script" and "src" not in attrs):
                f["large_inline_blocks"] += len(text) > 500
            continue

        if name == "meta":
            content = attrs.get("content", "")
            if "name" in attrs:
                f["description_count"] += attrs["name"] == "description"
                names.setdefault(attrs["name"], content)
            if "property" in attrs:
                props.setdefault(attrs["property"], content)
            if attrs.get("charset") and f["charset"] is None:
                f["charset"] = attrs["charset"]
            if attrs.get("http-equiv", "").lower() == "content-type":
                http_equiv = http_equiv or content
        elif name == "link" and attrs.get("rel") == "canonical" and f["canonical"] is None:
            f["canonical"] = attrs.get("href", "")
        elif name == "html" and f["lang"] is None:
            f["lang"] = attrs.get("lang", "")
        elif name == "a" and "href" in attrs:
            f["rel_author"] |= attrs.get("rel") == "author"
            body_links.append(attrs["href"])
            for _, key in open_scopes:
                scopes[key][1].append(attrs["href"])
        elif name == "time" and attrs.get("datetime"):
            times.append(attrs["datetime"])
        elif name == "figcaption" and "figure" in stack:
            f["figure_with_caption"] = True
        cls = attrs.get("class", "")
        f["byline"] |= "author" in cls or "byline" in cls or attrs.get("itemprop") == "author"
        if name in VOID or m.group("attrs").endswith("/"):
            continue

        if name == "body":
            in_body = body_seen = True
        stack.append(name)
        depth = len(stack)
        if name in ("main", "article") and name not in scopes:
            scopes[name] = ([], [])
            open_scopes.append((depth, name))
        if name in HEADINGS:
            parts: list = []
            headings.append((int(name[1]), parts))
            collectors.append((depth, parts))
        elif name == "p":
            parts = []
            inside = "main" in stack or "article" in stack
            paragraphs.append((nodes - 1, bool(chrome), inside, parts))
            collectors.append((depth, parts))
        elif name == "title":
            f["title_count"] += 1
            if f["title_count"] == 1:
                f["title"] = []
                collectors.append((depth, f["title"]))
        root = attrs.get("id") if attrs.get("id") in SPA_ROOT_IDS else ("app-root" if name == "app-root" else None)
        if root and root not in spa:
            spa[root] = []
            collectors.append((depth, spa[root]))
        chrome += name in CHROME
    add_text(html[pos:])

    texts = [(i, out, inside, _join(parts).strip()) for i, out, inside, parts in paragraphs]
    first = next((t for t in texts if len(t[3]) >= 50 and not t[1]), None)
    landmark = "main" if "main" in scopes else "article" if "article" in scopes else None
    head_text, body_text = _join(head), _join(body)
    content = " ".join(_join(scopes[landmark][0] if landmark else plain).split())
    numbers = len(NUMBER.findall(content))
    empty_roots = [r for r in ("app-root", *SPA_ROOT_IDS) if r in spa and len(_join(spa[r]).strip()) < 30]
    f.update(
        title=None if f["title"] is None else _join(f["title"]),
        charset=f["charset"] or http_equiv,
        meta_names=list(names.items()), meta_properties=list(props.items()),
        headings=[{"level": n, "text": _join(parts).strip()} for n, parts in headings],
        tag_counts=[(t, counts.get(t, 0)) for t in COUNTED], node_count=nodes,
        paragraphs=[{"chars": len(t[3]), "words": len(_words(t[3]))} for t in texts],
        first_p_index=first[0] if first else None, first_p_in_content=first[2] if first else None,
        text_chars=len(head_text) + len(body_text) + raw_chars,
        visible_bytes=len((head_text + body_text).strip().encode()), word_count=len(_words(head_text + body_text)),
        body_words=sum(len(w) >= 2 for w in body_text.split()), number_count=numbers,
        visible_numbers=numbers if landmark else len(NUMBER.findall(body_text)), **_text_stats(content),
        # the text itself is needed only to look up structured questions in it
        body_text=body_text if json_ld else None,
        content_links=scopes[landmark][1] if landmark else body_links,
        json_ld=json_ld, time_values=times, spa_root=empty_roots[0] if empty_roots else None,
    )
    return f


def _arrow_schema(key_fields: list) -> pa.Schema:
    text_map = pa.map_(pa.string(), pa.string())
    return pa.schema(
        key_fields
        + [
            ("error", pa.string()), ("title_count", pa.int32()), ("title", pa.string()), ("meta_names", text_map),
            ("meta_properties", text_map), ("description_count", pa.int32()), ("charset", pa.string()),
            ("canonical", pa.string()), ("lang", pa.string()),
            ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))),
            ("tag_counts", pa.map_(pa.string(), pa.int32())), ("node_count", pa.int32()),
            ("paragraphs", pa.list_(pa.struct([("chars", pa.int32()), ("words", pa.int32())]))),
            ("first_p_index", pa.int32()), ("first_p_in_content", pa.bool_()), ("text_chars", pa.int64()),
            ("visible_bytes", pa.int64()),
            *[(n, pa.int32()) for n in (
                "word_count", "body_words", "content_words", "plain_words", "distinct_words", "top_word_count", "long_words")],
            ("sentence_words", pa.list_(pa.int32())),
            *[(n, pa.int32()) for n in ("sentence_count", "question_count", "number_count", "visible_numbers")],
            ("body_text", pa.string()), ("content_links", pa.list_(pa.string())),
            ("external_scripts", pa.int32()), ("inline_script_chars", pa.int64()), ("large_inline_blocks", pa.int32()),
            ("noscript_chars", pa.int64()), ("json_ld", pa.list_(pa.string())), ("time_values", pa.list_(pa.string())),
            ("rel_author", pa.bool_()), ("byline", pa.bool_()), ("figure_with_caption", pa.bool_()),
            ("spa_root", pa.string()),
        ]
    )


def extract_page_facts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row of facts per page. Page size metrics and native html tests are added as JVM expressions.

    ``pages`` needs ``key`` (long), ``final_url`` and ``html``; ``redirects`` is optional. A page that cannot
    be read gives a row with ``error`` set instead of failing the task.
    """
    redirects = F.size("redirects") if "redirects" in pages.columns else F.lit(0)
    framework = F.coalesce(*[F.when(F.col("html").rlike(p), F.lit(n)) for n, p in K.FRAMEWORKS])
    source = pages.select(
        key, "final_url", F.octet_length("html").alias("html_bytes"), F.length("html").alias("html_chars"),
        redirects.alias("redirect_count"), framework.alias("framework"), "html",
    )
    carried = ["final_url", "html_bytes", "html_chars", "redirect_count", "framework"]
    key_fields = [
        (key, pa.int64()), ("final_url", pa.string()), ("html_bytes", pa.int32()), ("html_chars", pa.int32()),
        ("redirect_count", pa.int32()), ("framework", pa.string()),
    ]
    out_schema = _arrow_schema(key_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.drop_columns(["html"]).to_pylist()
            for row, html in zip(rows, batch.column("html").to_pylist()):
                try:
                    row.update(page_facts(html), error=None)
                except Exception as e:  # isolate a bad page: its checks get status 'error'
                    row["error"] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    ddl = f"{key} LONG, final_url STRING, html_bytes INT, html_chars INT, redirect_count INT, framework STRING, " + FACTS_DDL
    return source.select(key, *carried, "html").mapInArrow(run, ddl)
