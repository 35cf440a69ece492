"""Invariants over generated inputs: one Spark job per batch of examples."""

import random
import re
from html.entities import html5

from helpers import applied
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomtext.functions.entities import decode_entities
from loomtext.operators import qa
from loomtext.operators.extract import extract
from loomtext.operators.strip import StripOptions, strip_to_text

PAIRS = "p div span a b i em strong h1 h2 h3 table tr td ul ol li section article main blockquote code pre".split()
SKIPS = "script style nav header footer aside noscript form svg".split()
NAMED = "&amp; &lt; &gt; &quot; &nbsp; &copy; &eacute; &mdash; &#65; &#x41; &#150; &hellip".split()
BATCH = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))

text = st.text("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789 .,!?'-", min_size=1, max_size=30)
part = st.one_of(
    text,
    st.tuples(st.sampled_from(PAIRS), text).map(lambda x: f"<{x[0]}>{x[1]}</{x[0]}>"),
    st.tuples(st.sampled_from(SKIPS), text).map(lambda x: f"<{x[0]}>{x[1]}</{x[0]}>"),
    st.sampled_from(NAMED), st.sampled_from(PAIRS).map(lambda t: f"<{t} />"), text.map(lambda t: f"<!-- {t} -->"),
)
fragment = st.lists(part, min_size=1, max_size=19).map("".join)
anything = st.text(max_size=200).map(lambda s: "".join(c for c in s if not 0xD800 <= ord(c) < 0xE000))


def batch(strategy, size=60):
    return st.lists(strategy, min_size=size, max_size=size)


@BATCH
@given(batch(fragment), batch(anything))
def test_strip_output(spark, fragments, strings):
    sources = fragments + strings
    for source, got in zip(sources, applied(spark, sources, strip_to_text)):
        assert "  " not in got and got == got.strip(" ")
        assert not re.search("[\x00-\x08\x0b\x0c\x0e-\x1f​-‏­⁠﻿]", got)
        assert len(got.encode()) <= len(source.encode())
        if "&" not in source:
            assert not re.search(qa.TAG, got)


@BATCH
@given(batch(st.tuples(st.sampled_from([s for s in SKIPS if s not in ("script", "style")]), st.sampled_from(SKIPS))))
def test_skipped_content_never_leaks(spark, pairs):
    sources = [f"<p>before</p><{a}>SECRET<{b}>SECRET</{b}></{a}><p>after</p>" for a, b in pairs]
    for got in applied(spark, sources, strip_to_text):
        assert "SECRET" not in got and "before" in got and "after" in got


@BATCH
@given(batch(st.text("abcdefghij ", min_size=1, max_size=20)), st.integers(1, 999))
def test_text_is_kept(spark, words, number):
    for word, got in zip(words, applied(spark, [f"<p>{w}</p>" for w in words], strip_to_text)):
        assert got == " ".join(word.split())
    assert applied(spark, words, decode_entities) == words
    marked = [f"<p>{w}[{number}][edit][citation needed]</p>" for w in words]
    for got in applied(spark, marked, lambda c: strip_to_text(c, StripOptions.wikipedia())):
        assert "[" not in got
    assert all(f"[{number}]" in got for got in applied(spark, marked, strip_to_text))
    assert all(r.format == "plain_text" and r.text == w for r, w in zip(applied(spark, words, extract), words))


def reference_strip(source):
    """An independent model of stripping: a character loop over the documented rules."""
    from loomtext.functions import constants as k

    out, skip, wiki, script, style, pos, n = "", 0, 0, False, False, 0, len(source)
    while pos < n:
        if source[pos] != "<":
            end = source.find("<", pos)
            end = n if end < 0 else end
            if not (script or style or skip):
                out += model_decode(source[pos:end])
            pos = end
            continue
        if source.startswith("<!--", pos):
            end = source.find("-->", pos + 4)
            pos = n if end < 0 else end + 3
            continue
        if source.startswith("<!", pos):
            end = source.find(">", pos)
            pos = n if end < 0 else end + 1
            continue
        at, quote, name_end = pos + 1, None, None
        while at < n:
            c = source[at]
            if quote:
                quote = None if c == quote else quote
            elif c == ">":
                break
            elif name_end is None and c in " \t\n\f\r":
                name_end = at
            elif name_end is not None and c in "\"'":
                quote = c
            at += 1
        tag = source[pos : at + 1]
        name = source[pos + 1 : name_end if name_end is not None else at].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        pos = at + 1
        script = {"script": True, "/script": False}.get(name, script)
        style = {"style": True, "/style": False}.get(name, style)
        closing = name[1:] if name.startswith("/") else None
        if name in k.WIKI_TAGS and any(x in value_of(tag, a) for a in ("class", "id") for x in k.WIKI_IDS):
            wiki, skip = wiki + 1, skip + 1
        if wiki and closing in k.WIKI_TAGS:
            wiki, skip = wiki - 1, max(0, skip - 1)
        if closing in k.SKIP_TAGS:
            skip = max(0, skip - 1)
        elif name in k.SKIP_TAGS:
            skip += 1
        if not (script or style or skip) and name.removeprefix("/").removesuffix("/") in k.BLOCK_TAGS and out and not out.endswith(" "):
            out += " "
    return re.sub(" +", " ", out).strip(" ")


def value_of(tag, name):
    """The first attribute of the name, in quotes or without, lower-cased."""
    for at in range(len(tag)):
        if tag[at : at + len(name) + 1].lower() == name + "=" and (at == 0 or tag[at - 1] in " \t\n\r\"'<"):
            rest = tag[at + len(name) + 1 :].lstrip()
            if rest[:1] in ('"', "'") and rest:
                inner, closed, _ = rest[1:].partition(rest[0])
                return inner.lower() if closed else ""
            return re.match(r"[^\s>]*", rest)[0].lower()
    return ""


def model_decode(text):
    """References by HTML 5's names and Python's cp1252; unknown ones stay."""

    def one(m):
        whole, body = m[0], m[1]
        number = re.fullmatch("#(?:[xX]([0-9a-fA-F]+)|([0-9]+))", body)
        if not number or not whole.endswith(";"):
            named = " " if body == "nbsp" else html5.get(body + ";") if re.fullmatch("[A-Za-z0-9]+", body) else None
            return named or whole
        n = int(number[1], 16) if number[1] else int(number[2])
        if n > 0xFFFFFFFF:
            return whole
        if n == 0 or n > 0x10FFFF or 0xD800 <= n < 0xE000:
            return "\ufffd"
        return bytes([n]).decode("cp1252", "replace") if 128 <= n < 160 else chr(n)

    return re.sub(r"&([^; \t\n\r<]*);?", one, text)


def test_strip_agrees_with_a_character_loop(spark):
    rng = random.Random(5)
    atoms = ["<p>", "</p>", "<nav>", "</nav>", "<script>", "</script>", "<style>", "</style>", "<div class=\"toc\">", "<div>", "</div>", "<br/>", "<svg />", "</aside>", "<b>", "</b>",
             "<!-- x -->", "<!d>", "<", ">", "'", '"', " ", "a", "b c", "&amp;", "&lt;", "&", ";", "<td a='>'>", "<i x=\"", "</SPAN>", "<LI>", "<span id=\"navbox\">",
             "<ul CLASS='x RefList'>", "<table id=catlinks>", "<ol class=plain id='toc'>", "</ul>", "</ol>", "</table>", "&eacute;", "&mdash", "&#65;", "&#x41;", "&#150;", "&#129;", "&#0;", "&nosuch;", "&hellip;", "&nbsp;"]
    sources = ["".join(rng.choices(atoms, k=rng.randint(1, 14))) for _ in range(3000)]
    for source, got in zip(sources, applied(spark, sources, strip_to_text)):
        assert got == reference_strip(source), source
