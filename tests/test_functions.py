from helpers import applied
from pyspark.sql import functions as F

from loomtext.functions import attributes, cleanup, constants, detect, entities, formats, markers, tokens

DECODED = [
    ("&Uuml;bung", "Übung"), ("&#174; mark", "® mark"), ("plain words only", "plain words only"),
    ("&lt;td&gt; &quot;x&quot; &amp; y", '<td> "x" & y'), ("&reg; &#8211; &#x2026;", "® – …"),
    ("&Sacute;wi&eogonek;to &lstrok;&aogonek;ka", "Święto łąka"), ("&Gbreve;&scedil;&inodot;", "Ğşı"),
    ("&Rcaron;eka &amp; &zcaron;ivot", "Řeka & život"), ("&amp;lt;", "&lt;"), ("&#00;&#141;&#xDFFF;&#x110001;", "�" * 4),
    ("&#145;&#146;&#130;&#140;", "‘’‚Œ"), ("&#88888888888;", "&#88888888888;"), ("&#12q;", "&#12q;"), ("&nosuch;", "&nosuch;"), ("&#174", "&#174"),
    ("&mdash more", "— more"), ("&#777777777;", "�"), ("&#;&#X;&QUOT;", "&#;&#X;&QUOT;"), ("&reg2020", "&reg2020"), ("&gt&lt", "&gt&lt"),
    ("&#+66;&#x+42;", "BB"), ("&nbsp;&#160;", " \u00a0"), ("AT&T&amp;co", "AT&T&amp;co"), ("&#4294967296;", "&#4294967296;"), ("&#x1F33F;", "🌿"), (None, None), ("", ""),
]


def test_decode_entities(spark):
    assert applied(spark, [a for a, _ in DECODED], entities.decode_entities) == [b for _, b in DECODED]


def test_decode_byte_order_mark(spark):
    cases = [("&#65279;", "\ufeff"), ("a&#xFEFF;&#xfeff;b", "a\ufeff\ufeffb"), ("&#65278;&#xFFFE;&#65280;", "\ufefe\ufffe\uff00")]
    assert applied(spark, [a for a, _ in cases], entities.decode_entities) == [b for _, b in cases]


def test_entity_table():
    assert len(constants.ENTITIES) == 303
    assert constants.ENTITIES["nbsp"] == 0x20 and constants.ENTITIES["lang"] == 0x2329 and constants.ENTITIES["Eogonek"] == 0x118
    assert len(constants.WINDOWS_1252) == 27 and 0x81 not in constants.WINDOWS_1252


def test_cleanup(spark):
    cases = [("k \t\n m", "k m"), (" solo ", "solo"), ("k\u200b m", "k m"), ("k \u200b m", "k m"), ("\u00a0k\u3000m\u00a0", "k m"), ("k\x00\x7fm", "km"), (None, None), ("", "")]
    assert applied(spark, [a for a, _ in cases], cleanup.cleanup_whitespace) == [b for _, b in cases]


def test_markers(spark):
    cases = [("y[4] z[edit]", "y z"), ("[34", "[34"), ("2edit] edit] [5] edit] v", "2edit] edit]   v"), (None, None)]
    assert applied(spark, [a for a, _ in cases], markers.strip_ref_markers) == [b for _, b in cases]


def test_detect_str(spark):
    cases = [
        ("<!doctype html><title>k</title>", "html"), ("<h1>Rain</h1>", "html"), ('<?xml version="1.1"?><feed/>', "html"), ("\t\n <!-- note --> x", "html"),
        ("Rain until noon.", "plain_text"), ("", "plain_text"), ("while k < 7 and m > 2", "plain_text"), ("<4 days left", "plain_text"),
        ("Replace <host> by the server's own name", "plain_text"), ("<hr>", "plain_text"), ("see <heading><bodywork>", "html"),
        ("\ufeff<html lang=fr>", "plain_text"), ("<dl>" + "y" * 1200 + "</dl>", "plain_text"), (None, None),
    ]
    assert applied(spark, [a for a, _ in cases], detect.detect_str) == [b for _, b in cases]


def test_detect_bytes(spark):
    cases = [(b"%PDF-2.0 x", "pdf"), (b"\xfe\xff\x00k", "unknown"), (b"", "plain_text"), (b"<html><title>k</title></html>", "html"), (b"rain", "plain_text"), (None, None)]
    assert applied(spark, [None if a is None else bytearray(a) for a, _ in cases], detect.detect_bytes, "binary") == [b for _, b in cases]
    assert applied(spark, [bytearray(b"%PDF"), bytearray(b"%PD")], detect.is_pdf, "binary") == [True, False]


def test_detect_path(spark):
    cases = [
        ("index.html", "html"), ("INDEX.HTM", "html"), ("old.copy.xhtml", "html"), ("minutes.may.pdf", "pdf"), ("CHANGES.md", "markdown"), ("k.mkd", "markdown"),
        ("rain.txt", "plain_text"), ("map.jpeg", "unknown"), ("Makefile", "unknown"), (".profile", "unknown"), ("k/m.html/", "html"), ("k.d/m", "unknown"), (None, None),
    ]
    assert applied(spark, [a for a, _ in cases], detect.detect_path) == [b for _, b in cases]


def test_formats(spark):
    names = ["plain_text", "html", "pdf", "markdown", "unknown", "x", None]
    assert applied(spark, names, formats.mime_type) == ["text/plain", "text/html", "application/pdf", "text/markdown", "application/octet-stream", None, None]
    assert applied(spark, names, formats.display_name) == ["plain text", "HTML", "PDF", "Markdown", "unknown", None, None]


def test_attributes(spark):
    cases = [
        ('<ul class="plain">', "plain"), ('<ul data-class="shown" class="real">', "real"), ('<ul id="only">', None), ('<ul CLASS="loud">', "loud"),
        ("<ul class='soft'>", "soft"), ('<ul data-class="shown">', None), ("<ul class=k>", "k"), ('<ul class="never closed>', None), ("<ul class = k>", None), ('<ul class="">', ""), (None, None),
    ]
    assert applied(spark, [a for a, _ in cases], lambda c: attributes.attribute_value(c, "class")) == [b for _, b in cases]


def test_tokens_tile_the_input(spark):
    pages = ["<p a='>'>x<!-- <b> -->y<", "a<b", "", "<!doctype x><i>", "<" * 50, "<a " + "b='c' " * 20000 + ">", "<!--" + "x" * 200000]
    got = applied(spark, pages, lambda c: F.array_join(tokens.markup_tokens(c), ""))
    assert got == pages
