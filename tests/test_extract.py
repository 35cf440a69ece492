import base64
import random
import textwrap
import zlib

import pytest
from helpers import applied
from pyspark.sql import functions as F

from loomtext.operators import extract as e
from loomtext.operators import layout, pdf, qa, readable
from loomtext.plans.catalogue import pdf_page, pdf_stream, sample_pdf
from loomtext.sources import pool

ARTICLE = (
    "<html><head><title>Site | Story</title><meta name='description' content='About it'></head><body><nav>Menu here</nav>"
    "<div class='sidebar'>Links, links, and more links for everyone to see here</div><article class='post'><h1>Story</h1>"
    "<p>This is the first paragraph of the story, and it has commas, words, and length enough.</p>"
    "<table><tr><td>Born</td><td>1879</td></tr></table>"
    "<p>This is the second paragraph, which also has a number of words in it, as one may see.</p></article>"
    "<footer>Copyright</footer></body></html>"
)


def test_extract(spark):
    rows = applied(spark, ["<html><body><h1>Rain</h1></body></html>", "no  markup &amp;", "", None], e.extract)
    assert [r and (r.text, r.format, r.extractor, r.title, r.excerpt, r.fallback) for r in rows] == [
        ("Rain", "html", "strip", None, None, False), ("no  markup &amp;", "plain_text", "passthrough", None, None, False),
        ("", "plain_text", "passthrough", None, None, False), None,
    ]


@pytest.mark.parametrize("fmt,text,extractor", [("html", "rain", "strip"), ("plain_text", "<u>rain</u>", "passthrough"), ("markdown", "<u>rain</u>", "passthrough"), ("unknown", "<u>rain</u>", "passthrough")])
def test_extract_as(spark, fmt, text, extractor):
    row = applied(spark, ["<u>rain</u>"], lambda c: e.extract_as(c, fmt))[0]
    assert (row.text, row.format, row.extractor) == (text, fmt, extractor)


def test_pdf_from_a_string_is_an_error(spark):
    with pytest.raises(Exception, match="unsupported format: PDF"):
        applied(spark, ["x"], lambda c: e.extract_as(c, "pdf"))
    row = applied(spark, ["x"], lambda c: e.try_extract_as(c, "pdf"))[0]
    assert row.value is None and row.error.kind == "unsupported_format" and "PDF" in row.error.message
    row = applied(spark, ["<p>x</p>"], e.try_extract)[0]
    assert row.value.text == "x" and row.error is None


def test_readable(spark):
    found, short = applied(spark, [ARTICLE, "<h1>brief</h1>"], readable.extract_readable)
    assert found.extractor == "readability" and not found.fallback and found.title == "Site | Story" and found.excerpt == "About it"
    assert "first paragraph" in found.text and "second paragraph" in found.text and "Menu" not in found.text and "Born1879" not in found.text
    assert (short.text, short.extractor, short.fallback, short.title) == ("brief", "strip", True, None)


def test_layout(spark):
    page = "<h1>T</h1><p>one <a href='u'>link</a> two</p><ul><li>a</li><li>b</li></ul><ol><li>c</li></ol><table><tr><th>x</th><td>yy</td></tr></table><script>z()</script>"
    row = applied(spark, [page], lambda c: layout.extract_html2text(c, 40))[0]
    assert row.extractor == "html2text" and "# T" in row.text and "* a" in row.text and "1. c" in row.text and "x | yy" in row.text
    assert "[link][1]" in row.text and "[1]: u" in row.text and "z()" not in row.text
    long = applied(spark, ["<p>" + "word " * 100 + "</p>"], lambda c: layout.extract_html2text(c, 30))[0].text
    assert max(map(len, long.split("\n"))) <= 30
    assert applied(spark, ["<p>" + "word " * 100 + "</p>"], lambda c: layout.extract_html2text(c, 10000))[0].text.count("\n") == 1


def test_pdf(spark):
    files = [sample_pdf(["Hello", "a (b) \\ c"]), sample_pdf(["raw"], False), sample_pdf([" "]), b"%PDF-1.4", b"text", None]
    rows = applied(spark, [None if x is None else bytearray(x) for x in files], pdf.try_extract_pdf_bytes, "binary")
    assert rows[0].value.text == "Hello\na (b) \\ c\n" and rows[0].value.format == "pdf" and rows[0].value.extractor == "pdf-extract"
    assert rows[1].value.text == "raw\n"
    assert [r.error.kind for r in rows[2:5]] == ["empty_result", "io", "io"]
    assert rows[3].error.message.startswith("I/O error: PDF extraction failed: ")
    assert rows[5].value is None and rows[5].error is None
    with pytest.raises(Exception, match="extraction produced no text"):
        applied(spark, [bytearray(files[2])], pdf.extract_pdf_bytes, "binary")


def lzw(data):
    """A plain encoder: 9 to 12 bits, early change."""
    table, width, bits, w = {bytes([i]): i for i in range(256)}, 9, format(256, "09b"), b""
    size = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        bits += format(table[w], f"0{width}b")
        table[w + c] = size
        size += 1
        width = max(9, size.bit_length())
        w = c
    bits += format(table[w], f"0{width}b") if w else ""
    bits += format(257, f"0{max(9, (size + 1).bit_length())}b")
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def png_rows(data, columns):
    """Rows under the five PNG row filters in turn."""
    out, above = b"", bytes(columns)
    for n, at in enumerate(range(0, len(data), columns)):
        row = data[at : at + columns].ljust(columns, b" ")
        coded = bytearray()
        for i, x in enumerate(row):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            near = left + up - corner
            best = min((left, up, corner), key=lambda v: abs(near - v))
            coded.append((x - (0, left, up, (left + up) // 2, best)[n % 5]) % 256)
        out += bytes([n % 5]) + coded
        above = row
    return out


def pdf_texts(spark, files):
    rows = applied(spark, [bytearray(x) for x in files], pdf.try_extract_pdf_bytes, "binary")
    return [r.value.text if r.value else r.error.kind for r in rows]


def test_pdf_filters(spark):
    content = b"BT /F1 12 Tf 14 TL 72 720 Td\n" + b"".join(b"(row %d of the rain table) Tj T*\n" % i for i in range(300)) + b"ET"
    want = "".join(f"row {i} of the rain table\n" for i in range(300))
    runs = b"".join(bytes([len(content[i : i + 100]) - 1]) + content[i : i + 100] for i in range(0, len(content), 100)) + b"\xfe \x80"
    files = [
        pdf_page(pdf_stream(base64.a85encode(content) + b"~>", b"/Filter /ASCII85Decode")),
        pdf_page(pdf_stream(content.hex().encode() + b">", b"/Filter [/ASCIIHexDecode]")),
        pdf_page(pdf_stream(runs, b"/Filter /RunLengthDecode")),
        pdf_page(pdf_stream(lzw(content), b"/Filter /LZWDecode")),
        pdf_page(pdf_stream(base64.a85encode(zlib.compress(content)) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]")),
        pdf_page(pdf_stream(zlib.compress(png_rows(content, 40)), b"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 40 >>")),
        pdf_page(pdf_stream(b"x", b"/Filter /DCTDecode")),
    ]
    got = pdf_texts(spark, files)
    assert got[:6] == [want] * 6 and got[6] == "io"


def test_pdf_forms_fonts_and_encryption(spark):
    form = b"<< /Type /XObject /Subtype /Form /Resources << /Font << /F1 5 0 R >> >> /Length 60 >>\nstream\nBT /F1 9 Tf (in the form) Tj ET /Me Do\nendstream"
    draw = pdf_stream(b"BT /F1 9 Tf (before) Tj ET /Me Do BT (after /Encrypt) Tj ET BI /W 1 ID (no) Tj EI")
    composite = b"<< /Type /Font /Subtype /Type0 /BaseFont /K >>"
    files = [
        pdf_page(draw, b"/Font << /F1 5 0 R >> /XObject << /Me 6 0 R >>", form),
        pdf_page(pdf_stream(b"BT /F2 9 Tf <0041> Tj ET"), b"/Font << /F1 5 0 R /F2 6 0 R >>", composite),
        sample_pdf(["k"]).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"),
    ]
    assert pdf_texts(spark, files) == ["before\nin the form\nafter /Encrypt\n", "io", "io"]


def test_layout_of_deep_pages(spark):
    page = "<div>" * 3000 + "deep <b>down</b>" + "</div>" * 3000 + "<blockquote>" * 8 + "quoted"
    row = applied(spark, [page], lambda c: layout.extract_html2text(c, 60))[0]
    assert row.extractor == "html2text" and "deep **down**" in row.text and "> > > > > > > > quoted" in row.text


def test_wrapped_lines():
    rng = random.Random(6)
    for _ in range(500):
        words = ["k" * rng.choice([1, 2, 5, 9, 40]) for _ in range(rng.randint(0, 30))]
        first, rest, room = rng.choice([("", ""), ("* ", "  "), ("> > ", "> > ")]) + (rng.randint(8, 40),)
        want = textwrap.wrap(" ".join(words), room, initial_indent=first, subsequent_indent=rest)
        assert layout.wrapped(words, room, first, rest) == [x.rstrip() for x in want]


def test_qa(spark):
    df = spark.createDataFrame([("ok text", "<p>"), (" a  b", "<script x"), ("<p>x</p>\x01​", "<body"), ("x", "<body>" + "y" * 300)], "t string, h string")
    rows = [{c.name: c.passed for c in r[0]} for r in df.select(qa.checks("t", "h")).collect()]
    assert all(rows[0].values()) and len(rows[0]) == 7
    assert not rows[1]["no_double_spaces"] and not rows[1]["trimmed"]
    assert not rows[2]["no_html_tags"] and not rows[2]["no_control_chars"] and not rows[2]["no_invisible_chars"]
    assert not rows[3]["non_empty"]
    total = qa.summary(df.select(qa.checks("t", "h").alias("checks"))).first()
    assert (total.documents, total.checks, total.failed_checks) == (4, 28, 6)
    empty = qa.summary(df.limit(0).select(qa.checks("t", "h").alias("checks"))).first()
    assert tuple(empty) == (0, 0, 0, 0)
    with pytest.raises(AssertionError):
        qa.assert_clean(qa.summary(df.select(qa.checks("t", "h").alias("checks"))))
    results = qa.tested(df.select("t", "h", F.lit("u").alias("url"), F.lit("en").alias("lang")), "t", "h")
    assert sum("[PASS] en" in r.value for r in qa.report_lines(results).collect()) == 1


def test_results_with_errors(spark):
    df = spark.createDataFrame([("u", "<p>k</p>", None, 12.4), ("v", None, "timed out", None)], "url string, html string, error string, fetch_ms double")
    found = qa.tested(df.withColumn("text", F.lit("k")), "text")
    assert found.columns == [x.split()[0] for x in qa.RESULT.split(", ")]
    whole = "\n".join(r.value for r in qa.report(found, "today", 5).orderBy("place").collect())
    assert "### [PASS] - u" in whole and "### [ERROR] - v\n\nError: timed out" in whole and "- Errors: 1" in whole and "- Seed: 5" in whole
    assert qa.exit_status(qa.summary(found, error="error")).first().status == 1


def test_sample_is_exact(spark):
    made = spark.createDataFrame([(str(i), "en", "news" if i % 2 else "forum") for i in range(100)], "url string, lang string, cat string")
    a, b = ({r.draw: r.url for r in pool.sample_pool(x, 500, 7, "news").collect()} for x in (made, made.repartition(3)))
    assert a == b and sorted(a) == list(range(500)) and all(int(u) % 2 for u in a.values()) and len(set(a.values())) > 40
    assert pool.sample_pool(made.limit(0), 5, 1).count() == 0
    own = spark.createDataFrame([("http://www.x.org/de/1?a",), ("http://www.x.org/de/1?a",), ("https://y.net",), (None,)], "url string")
    assert sorted(map(tuple, pool.pool_of_pages(own).collect())) == [("http://www.x.org/de/1?a", "de", "org"), ("https://y.net", "", "net")]


def test_errors_have_a_cause(spark):
    from loomtext.operators.extract import try_extract_as
    from loomtext.operators.pdf import try_extract_pdf_bytes

    df = spark.createDataFrame([(bytearray(b"%PDF-1.4 k"),), (bytearray(b"no pdf"),)], "b binary")
    errors = [r.r.error for r in df.select(try_extract_pdf_bytes("b").alias("r")).collect()]
    assert all(e.kind == "io" and e.cause and e.message.endswith(e.cause) for e in errors)
    assert spark.range(1).select(try_extract_as(F.lit("k"), "pdf").alias("r")).first().r.error.cause is None


def test_fields_that_are_not_read_are_not_worked_out(spark):
    from loomtext.operators.extract import extract, extract_fields

    df = spark.createDataFrame([("<p>k</p>",), ("k",), ("",), (None,)], "x string").repartition(1)
    fields = df.select("x", *extract_fields("x"))
    assert "regexp_extract_all" not in fields.select("format")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in fields.select("text")._jdf.queryExecution().optimizedPlan().toString()
    whole = df.select("x", extract("x").alias("r")).select("x", "r.*")
    assert sorted(map(repr, fields.collect())) == sorted(map(repr, whole.select(fields.columns).collect()))


def test_every_name_has_a_slot_of_its_own():
    from loomtext.functions import entities

    assert sorted(n for n in entities._BY_SLOT if n) == sorted(entities._NAMED) and len(entities._NAMED) == 303
