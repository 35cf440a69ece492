"""Queries of all extraction operators over the tables and the inline cases."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes, cleanup, detect, entities, formats, markers, tokens
from ..functions.constants import ENTITIES
from ..operators import elements, extract, layout, pdf, qa, readable
from ..operators.strip import StripOptions, strip_to_text
from ..operators.wide import strip_wide
from ..sources import documents
from ..sources.shared import file_system, new_folder
from ..sources.tables import read_table
from . import cases, derived


def _cases(spark: SparkSession, values: tuple[str, ...], column: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"case_id int, {column} string")


def _on_cases(values: tuple[str, ...], column: str, **outputs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, _: _cases(spark, values, column).select("case_id", column, *[c().alias(n) for n, c in outputs.items()])


def _stripped_cases(values: tuple[str, ...], options: StripOptions | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, _: _cases(spark, values, "html").select("case_id", strip_to_text("html", options).alias("text"))


def strip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "pages").select("page_id", "url", detect.detect_str("html").alias("format"), strip_to_text("html").alias("text"))
    return found.withColumn("text_bytes", F.octet_length("text").cast("long"))


def strip_pages_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", strip_to_text("html", StripOptions.wikipedia()).alias("text"))


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", extract.extract("html").alias("r")).select("page_id", "r.*")


def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", extract.extract("text").alias("r")).select("doc_id", "r.*")


def extract_as_each_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.explode(F.array(*[F.lit(x) for x in formats.MIME])).alias("asked")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text", asked)
    tried = rows.select("doc_id", "asked", extract.try_extract_as("text", "asked").alias("r"))
    return tried.select("doc_id", "asked", "r.value.text", "r.value.extractor", F.col("r.error.kind").alias("error_kind"))


def try_extract_pdf_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, cases.FORMATS, "format").where("format <> 'html'")
    tried = rows.select("case_id", extract.try_extract_as(F.lit("body"), F.col("format")).alias("r"))
    return tried.select("case_id", F.col("r.error.kind").alias("error_kind"), F.col("r.error.message").alias("message"), F.col("r.value.text").alias("text"))


def _all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("x"))
    documents = read_table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    turns = read_table(spark, sf_dir, "conversations")
    turns = turns.select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("x"))
    return pages.unionByName(documents).unionByName(turns)


def detect_str_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_texts(spark, sf_dir).select("origin", "id", detect.detect_str("x").alias("format"))


def is_html_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_texts(spark, sf_dir).select("origin", "id", detect.is_html("x").alias("is_html"), detect.starts_with_tag("x").alias("starts_with_tag"))


def detect_path_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", detect.detect_path("url").alias("format"))


def decode_entities_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", entities.decode_entities("html").alias("decoded"))


def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(f"&{n};", p) for n, p in sorted(ENTITIES.items())], "name string, code_point int")
    return rows.withColumn("decoded", entities.decode_entities("name"))


def cleanup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", cleanup.cleanup_whitespace("text").alias("cleaned"))


def _page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = read_table(spark, sf_dir, "pages").select("page_id", F.posexplode(tokens.markup_tokens("html")).alias("at", "t"))
    return split.select("page_id", (F.col("at") + 1).cast("long").alias("position"), "t")


def tokens_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _page_tokens(spark, sf_dir).select("page_id", "position", tokens.token_kind(t).alias("kind"), tokens.tag_name(t).alias("name"), F.length(t).cast("long").alias("length"))


def attr_href_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _page_tokens(spark, sf_dir).where(tokens.token_kind(F.col("t")) == "tag")
    return tags.select("page_id", "position", attributes.attribute_value("t", "href").alias("href")).where("href is not null")


def _checked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html", strip_to_text("html").alias("text"))
    return pages.select("page_id", qa.checks("text", "html").alias("checks"))


def qa_checks_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_pages(spark, sf_dir).select("page_id", F.inline("checks")).select("page_id", "name", "passed")


def qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.summary(_checked_pages(spark, sf_dir))


def readable_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, cases.READABLE, "html").select("case_id", readable.extract_readable("html").alias("r")).select("case_id", "r.*")


def readable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", readable.extract_readable("html", "url").alias("r")).select("page_id", "r.*")


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", layout.extract_html2text("html", 80).alias("r")).select("page_id", "r.*")


def pdf_file(objects: list[bytes]) -> bytes:
    """A PDF of the objects, numbered from 1; the first is the catalog."""
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def pdf_stream(data: bytes, entries: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n" % (len(data), entries) + data + b"\nendstream"


def sample_pdf(lines: list[str], compressed: bool = True) -> bytes:
    """A one-page PDF of the lines."""
    shown = b"".join(b"(" + x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*\n" for x in lines)
    content = b"BT /F1 12 Tf 14 TL 72 720 Td\n" + shown + b"ET"
    return pdf_page(pdf_stream(zlib.compress(content), b"/Filter /FlateDecode") if compressed else pdf_stream(content))


def pdf_page(contents: bytes, resources: bytes = b"/Font << /F1 5 0 R >>", *more: bytes) -> bytes:
    """A PDF of one page: its content stream is object 4, a simple font 5, ``more`` from 6 on."""
    return pdf_file(
        [
            b"<< /Type /Catalog /Pages 2 0 R >>",
            b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
            b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << " + resources + b" >> >>",
            contents,
            b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
            *more,
        ]
    )


def layout_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _cases(spark, tuple(page for page, _ in cases.LAID_OUT), "html")
    return pages.select("case_id", layout.extract_html2text("html", 30).alias("r")).select("case_id", "r.*")


def pdf_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page under each filter and in a form, and pages that are errors."""
    content = b"BT /F1 12 Tf 14 TL 72 720 Td (rain and wind) Tj T* (until noon) Tj ET"
    form = b"<< /Type /XObject /Subtype /Form >>\nstream\n" + content + b"\nendstream"
    files = [
        pdf_page(pdf_stream(base64.a85encode(content) + b"~>", b"/Filter /ASCII85Decode")),
        pdf_page(pdf_stream(content.hex().encode() + b">", b"/Filter /ASCIIHexDecode")),
        pdf_page(pdf_stream(bytes([len(content) - 1]) + content + b"\x80", b"/Filter /RunLengthDecode")),
        pdf_page(pdf_stream(base64.a85encode(zlib.compress(content)) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]")),
        pdf_page(pdf_stream(b"/Fm Do"), b"/Font << /F1 5 0 R >> /XObject << /Fm 6 0 R >>", form),
        pdf_page(pdf_stream(b"k", b"/Filter /JPXDecode")),
        sample_pdf(["k"]).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"),
    ]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files)], "case_id int, content binary")
    return rows.select("case_id", pdf.try_extract_pdf_bytes("content").alias("r")).select("case_id", "r.value.text", F.col("r.error.kind").alias("error_kind"))


def pdf_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [sample_pdf(["Hello PDF", "second (line)"]), sample_pdf(["plain"], False), sample_pdf([""]), b"%PDF-1.4 broken", b"no pdf", b""]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files)], "case_id int, content binary")
    tried = rows.select("case_id", pdf.try_extract_pdf_bytes("content").alias("r"))
    return tried.select("case_id", "r.value.text", "r.value.extractor", F.col("r.error.kind").alias("error_kind"), F.col("r.error.message").alias("message"))


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files in the shared folder, read and extracted by path."""
    folder = new_folder(spark, "pdf")
    made = {"two-lines": sample_pdf(["Rain at noon", "wind (west)"]), "plain": sample_pdf(["k"], False), "blank": sample_pdf([""]), "broken": b"%PDF-1.4 k"}
    for name, content in made.items():
        files, target = file_system(spark, f"{folder}/{name}.pdf")
        out = files.create(target)
        out.write(bytearray(content))
        out.close()
    found = documents.extract_pdf_files(spark, folder)
    return found.select(F.regexp_extract("path", "([^/]*)[.]pdf$", 1).alias("name"), "value.text", F.col("error.kind").alias("error_kind"))


def strip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strip cases as one file each, stripped from folder to folder."""
    folder = new_folder(spark, "html")
    _cases(spark, cases.STRIP, "html").write.mode("append").partitionBy("case_id").text(folder)
    target = f"{new_folder(spark, 'text')}/out"
    documents.strip_files(spark, folder, target)
    return spark.read.text(target).select(F.col("value").alias("text"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").withColumn("error", F.when(F.col("html").isNull(), "no page"))
    return qa.tested(pages.withColumn("text", strip_to_text("html")), "text")


def qa_results_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.size(F.filter("checks", lambda c: ~c["passed"])).cast("long")
    return _results(spark, sf_dir).select("url", "html_len", "text_len", F.size("checks").cast("long").alias("n_checks"), failed.alias("n_failed"), "error")


def qa_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(cases.CHECKED)], "case_id int, t string, h string")
    return rows.select("case_id", F.inline(qa.checks("t", "h")))


def qa_exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.exit_status(qa_summary(spark, sf_dir))


def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written to the shared folder and read back."""
    target = f"{new_folder(spark, 'report')}/out"
    documents.write_report(qa.report(_results(spark, sf_dir), "2026-01-01", 7), target)
    return spark.read.text(target, wholetext=False).where("value <> ''").select(F.regexp_replace("value", "^(- .FAIL. [a-z_]+):.*$", "$1").alias("line"))


def readable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules say of an article, over pages made by a rule."""
    found = _cases(spark, cases.ARTICLES, "html").select("case_id", "html", readable.extract_readable("html").alias("r"))
    return found.select(
        "case_id", F.col("r.extractor").alias("extractor"), F.col("r.fallback").alias("fallback"), F.col("r.title").alias("title"),
        F.contains("r.text", F.lit("Home")).alias("has_menu"), F.contains("r.text", F.lit("Footer")).alias("has_footer"),
        F.size(F.regexp_extract_all("r.text", F.lit("(Paragraph [0-9]+ speaks of)"), F.lit(1))).cast("long").alias("paragraphs"),
    )


def strip_pages_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as if they were huge: dealt out in ranges of 64 tokens."""
    return strip_wide(read_table(spark, sf_dir, "pages"), wide_bytes=0, size=64)


def strip_pages_wiki_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_wide(read_table(spark, sf_dir, "pages"), options=StripOptions.wikipedia(), wide_bytes=0, size=64)


def elements_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.element_table(read_table(spark, sf_dir, "pages"))


def skip_regions_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.skip_regions(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "strip_pages": strip_pages,
    "strip_pages_wiki": strip_pages_wiki,
    "strip_pages_ranges": strip_pages_ranges,
    "strip_pages_wiki_ranges": strip_pages_wiki_ranges,
    "elements_pages": elements_pages,
    "skip_regions_pages": skip_regions_pages,
    "strip_cases": _stripped_cases(cases.STRIP),
    "wiki_skip_cases": _stripped_cases(cases.WIKI_SKIP),
    "img_alt_cases": _stripped_cases(cases.IMAGES),
    "strip_wiki_cases": _stripped_cases(cases.MARKERS, StripOptions.wikipedia()),
    "strip_corpora": _stripped_cases(cases.CORPORA),
    "strip_corpora_wiki": _stripped_cases(cases.CORPORA, StripOptions.wikipedia()),
    "ref_markers_cases": _on_cases(cases.MARKERS, "input", output=lambda: markers.strip_ref_markers("input")),
    "extract_pages": extract_pages,
    "extract_documents": extract_documents,
    "extract_as_each_format": extract_as_each_format,
    "try_extract_pdf_error": try_extract_pdf_error,
    "detect_str_all": detect_str_all,
    "is_html_all": is_html_all,
    "detect_str_cases": _on_cases(cases.DETECT, "content", format=lambda: detect.detect_str("content")),
    "detect_bytes_cases": _on_cases(cases.BYTES, "hex", format=lambda: detect.detect_bytes(F.unhex("hex"))),
    "is_pdf_cases": _on_cases(cases.BYTES, "hex", is_pdf=lambda: detect.is_pdf(F.unhex("hex"))),
    "detect_path_cases": _on_cases(cases.PATHS, "path", format=lambda: detect.detect_path("path")),
    "detect_path_pages": detect_path_pages,
    "format_mime": _on_cases(cases.FORMATS, "format", mime=lambda: formats.mime_type("format")),
    "format_display": _on_cases(cases.FORMATS, "format", display=lambda: formats.display_name("format")),
    "decode_entities_pages": decode_entities_pages,
    "decode_entities_cases": _on_cases(cases.ENTITIES, "input", output=lambda: entities.decode_entities("input")),
    "entity_table": entity_table,
    "cleanup_documents": cleanup_documents,
    "tokens_pages": tokens_pages,
    "attr_href_pages": attr_href_pages,
    "qa_checks_pages": qa_checks_pages,
    "qa_summary": qa_summary,
    "readable_fallback": readable_fallback,
    "readable_pages": readable_pages,
    "layout_pages": layout_pages,
    "readable_rules": readable_rules,
    "layout_cases": layout_cases,
    "pdf_cases": pdf_cases,
    "pdf_filters": pdf_filters,
    "pdf_files": pdf_files,
    "strip_files": strip_files,
    "qa_results_pages": qa_results_pages,
    "qa_details": qa_details,
    "qa_exit_status": qa_exit_status,
    "qa_report": qa_report,
    **derived.QUERIES,
}
