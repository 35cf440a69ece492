"""Article extraction: find the main content of a page, then strip it like any HTML.

The article is found by the publicly documented content-scoring approach of browser
reader views: paragraphs score by length and commas, ancestors inherit, link-heavy
and boilerplate blocks lose.  Finding it needs a tree and runs in Arrow batches;
stripping, the size gate and the fallback are built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats as f
from ..functions.common import as_column, let
from .dom import Element, parse
from .strip import strip_to_text

#: An article with less text than this, in bytes, is none.
LEAST_BYTES = 50
_UNLIKELY = re.compile(r"-ad-|banner|breadcrumb|combx|comment|community|cookie|disqus|footer|gdpr|header|menu|popup|promo|related|remark|rss|share|shoutbox|sidebar|skyscraper|social|sponsor|supplement|\bads?\b", re.I)
_MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
_GOOD = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"hidden|banner|combx|comment|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)
_NOT_CONTENT = frozenset("script style noscript template nav footer aside form iframe svg button input select textarea object embed".split())
_TAG_SCORE = {"article": 8, "div": 5, "section": 5, "main": 8, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5}


def _label(e: Element) -> str:
    return f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}"


def _base_score(e: Element) -> float:
    label = _label(e)
    return _TAG_SCORE.get(e.tag, 0) + (25 if _GOOD.search(label) else 0) - (25 if _BAD.search(label) else 0)


def _link_share(e: Element) -> float:
    total = len(e.text().strip()) or 1
    return sum(len(a.text().strip()) for a in e.elements() if a.tag == "a") / total


def _meta(elements: list[Element], *keys: str) -> str | None:
    for key in keys:
        for e in elements:
            if e.tag == "meta" and key in (e.attrs.get("property", "").lower(), e.attrs.get("name", "").lower()) and e.attrs.get("content", "").strip():
                return e.attrs["content"].strip()
    return None


def article(source: str) -> tuple[str, str | None, str | None] | None:
    """``(markup, title, excerpt)`` of a page's article, or None."""
    root = parse(source)
    elements = root.elements()
    named = next((e.text().strip() for e in elements if e.tag == "title"), "")
    title = _meta(elements, "og:title", "twitter:title") or " ".join(named.split())
    excerpt = _meta(elements, "og:description", "description", "twitter:description")
    for e in elements:
        label = _label(e)
        unlikely = _UNLIKELY.search(label) and not _MAYBE.search(label) and e.tag not in ("body", "article", "main", "html")
        if e.tag in _NOT_CONTENT or unlikely:
            e.remove()
    scores: dict[int, float] = {}
    found: dict[int, Element] = {}
    for e in root.elements():
        if e.tag not in ("p", "td", "pre", "blockquote", "li"):
            continue
        text = e.text().strip()
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        above, level = e.parent, 0
        while above is not None and above.tag not in ("#root", "html") and level < 4:
            if id(above) not in scores:
                scores[id(above)], found[id(above)] = _base_score(above), above
            scores[id(above)] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            above, level = above.parent, level + 1
    if not scores:
        return None
    final = {i: s * (1 - _link_share(found[i])) for i, s in scores.items()}
    top = found[max(final, key=final.get)]
    parts = [top]
    if top.parent is not None and top.parent.tag != "#root":
        least = max(10.0, final[id(top)] * 0.2)
        parts = [c for c in top.parent.children if isinstance(c, Element) and (c is top or final.get(id(c), 0) >= least or (c.tag == "p" and len(c.text()) > 80 and _link_share(c) < 0.25))]
    if excerpt is None:
        excerpt = next((" ".join(e.text().split()) for p in parts for e in [p, *p.elements()] if e.tag == "p" and e.text().strip()), None)
    return "<div>" + "".join(p.markup() for p in parts) + "</div>", title or None, excerpt


_ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("content", "title", "excerpt")])


@F.arrow_udf(_ARTICLE)
def _articles(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("content", pa.string()), ("title", pa.string()), ("excerpt", pa.string())])
    for batch in pages:
        rows = []
        for page in batch.to_pylist():
            try:
                got = article(page) if page is not None else None
            except (RecursionError, ValueError, AssertionError):
                got = None
            rows.append(dict(zip(("content", "title", "excerpt"), got)) if got else None)
        yield pa.array(rows, kind)


def extract_readable(html: Column | str, url: Column | str | None = None) -> Column:
    """Result struct of a page's article; of the whole page, with ``fallback``, if there is none.

    ``url`` is accepted for the sake of the signature; relative links do not matter to
    text.  Null stays null.
    """
    value = as_column(html)
    del url
    found = _articles(value)
    whole = f.extracted(strip_to_text(value), f.HTML, "strip", fallback=True)

    def chosen(a: Column) -> Column:
        best = f.extracted(a["text"], f.HTML, "readability", a["title"], a["excerpt"])
        return F.when(F.octet_length(a["text"]) >= LEAST_BYTES, best).otherwise(whole)

    stripped = F.struct(strip_to_text(found["content"]).alias("text"), found["title"].alias("title"), found["excerpt"].alias("excerpt"))
    return F.when(value.isNotNull(), let(stripped, chosen))
