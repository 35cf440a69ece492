"""Queries over inputs that are made from every row of the tables by a rule, and the SQL of the same rules.

The tables lack numeric references, wiki boilerplate, images, markers, invisible
characters and files.  Here each row gets some, chosen by its id, so that every row of a
table is an own case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleanup, detect, entities, formats, markers
from ..functions.constants import ENTITIES, WIKI_IDS, WIKI_TAGS
from ..operators import extract, qa
from ..operators.strip import StripOptions, strip_to_text
from ..sources import documents, fetch, files, heads, pool, reports
from ..sources.shared import new_folder
from ..sources.tables import read_table
from ..streaming import totals
from . import oracle as o

NAMES = tuple(sorted(ENTITIES))
#: Characters that clean-up drops or makes a space of.
STRANGE = (0xA0, 0xAD, 0x180E, 0x200B, 0x200F, 0x2028, 0x202A, 0x2060, 0x3000, 0xFE0F, 0xFEFF, 0x7F, 0x01, 0x0B, 0x0C, 0x1F, 0x85, 0x1680)
#: References that are none, or only just.
BROKEN = ("&#;", "&#X;", "&#+66;", "&#x+42;", "&nosuch;", "&lt", "&#12q;", "&QUOT;", "&;", "&#-7;", "&gt&lt", "& lt;", "&", "&reg2020", "&#x0000000042;", "&mdash more")
MARKS = ("[{}]", "[edit]", "[citation needed]", "edit]", "accredit]", "[[{}]]", "[k]", "kedit][{}]")


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.split(F.lit("\x04".join(values)), "\x04"), (n % len(values) + 1).cast("int"))


def _picked(values: tuple, n: str) -> str:
    return "[" + ", ".join(map(o.lit, values)) + f"][({n}) % {len(values)} + 1]"


def _chosen(points: tuple, n: str) -> str:
    return "[" + ", ".join(f"chr({p})" for p in points) + f"][({n}) % {len(points)} + 1]"


def references(n: Column) -> Column:
    """Three named references, decimal and hexadecimal ones of all ranges, Windows-1252 ones, and broken ones."""
    named = [F.concat(F.lit("&"), _pick(NAMES, 3 * n + i), F.lit(";")) for i in range(3)]
    numbers = [F.concat(F.lit("&#"), (v % m + a).cast("string"), F.lit(";")) for v, m, a in ((n * 37, 70_000, 0), (n, 34, 127), (n, 12, 4_294_967_290), (n * 7919, 1_200_000, 0))]
    digits = F.concat(F.lit("&#x"), F.lower(F.hex(n * 97 % 1_200_000)), F.lit(";"), F.lit("&#X"), F.hex(n % 2100 + 0xD7FF), F.lit(";"))
    return F.concat_ws(" ", *named, *numbers, digits, _pick(BROKEN, n))


def references_sql(n: str) -> str:
    named = [f"'&' || {_picked(NAMES, f'3 * {n} + {i}')} || ';'" for i in range(3)]
    numbers = [f"'&#' || ({v} % {m} + {a}) || ';'" for v, m, a in ((f"{n} * 37", 70_000, 0), (n, 34, 127), (n, 12, 4_294_967_290), (f"{n} * 7919", 1_200_000, 0))]
    digits = f"'&#x' || lower(printf('%X', {n} * 97 % 1200000)) || ';&#X' || printf('%X', {n} % 2100 + 55295) || ';'"
    return "concat_ws(' ', " + ", ".join([*named, *numbers, digits, _picked(BROKEN, n)]) + ")"


def enriched(n: Column, html: Column) -> Column:
    """The page behind boilerplate that hides something, an image, markers, a strange character and references."""
    tag = _pick(WIKI_TAGS, n)
    wiki = F.concat(F.lit("<"), tag, F.when(n % 2 == 0, F.lit(" class='My ")).otherwise(F.lit(' ID="')), _pick(WIKI_IDS, n), F.when(n % 2 == 0, F.lit("'>")).otherwise(F.lit('">')))
    hidden = F.concat(wiki, F.lit("hidden<p>deep</p></"), tag, F.lit(">shown "))
    image = F.concat(F.lit("<img src=m.gif alt='Map &amp; "), n.cast("string"), F.lit("'>"))
    mark = F.replace(_pick(MARKS, n), F.lit("{}"), n.cast("string"))
    return F.concat(hidden, image, F.lit("<p>said"), mark, F.lit(" a"), _pick(tuple(map(chr, STRANGE)), n), F.lit("b "), references(n), F.lit("</p>"), html)


def enriched_sql(n: str, html: str) -> str:
    tag = _picked(WIKI_TAGS, n)
    wiki = f"'<' || {tag} || CASE WHEN {n} % 2 = 0 THEN ' class=''My ' || {_picked(WIKI_IDS, n)} || '''>' ELSE ' ID=\"' || {_picked(WIKI_IDS, n)} || '\">' END"
    mark = f"replace({_picked(MARKS, n)}, '{{}}', {n}::VARCHAR)"
    return f"({wiki} || 'hidden<p>deep</p></' || {tag} || '>shown <img src=m.gif alt=''Map &amp; ' || {n} || '''><p>said' || {mark} || ' a' || {_chosen(STRANGE, n)} || 'b ' || {references_sql(n)} || '</p>' || {html})"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").withColumn("rich", enriched(F.col("page_id"), F.col("html")))


_RICH = f"SELECT page_id AS id, {enriched_sql('page_id', 'html')} AS x FROM pages"


def strip_rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", strip_to_text("rich").alias("text"))


def strip_rich_pages_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", strip_to_text("rich", StripOptions.wikipedia()).alias("text"))


def decode_references_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pages").select("page_id", references(F.col("page_id")).alias("input"))
    return rows.select("page_id", "input", entities.decode_entities("input").alias("output"))


def cleanup_strange_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth kind of word bound is a strange character, alone or beside a space."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" e"), F.concat(_pick(tuple(map(chr, STRANGE)), F.col("doc_id")), F.lit(" e"))).alias("x"))
    return rows.select("doc_id", cleanup.cleanup_whitespace("x").alias("cleaned"))


def ref_markers_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.replace(_pick(MARKS, F.col("doc_id")), F.lit("{}"), (F.col("doc_id") % 100).cast("string"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" "), F.concat(F.lit(" "), mark, F.lit(" "))).alias("x"))
    return rows.select("doc_id", markers.strip_ref_markers("x").alias("text"))


def detect_bytes_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the text, of a page, of a PDF, cut within a code point, behind stray bytes, or none."""
    text, n = F.col("text"), F.col("doc_id") % 6
    made = (
        F.when(n == 0, text.cast("binary")).when(n == 1, F.concat(F.lit("\n<html lang=k>"), text).cast("binary")).when(n == 2, F.concat(F.lit("%PDF-1.7\n"), text).cast("binary"))
        .when(n == 3, F.concat(text.cast("binary"), F.unhex(F.lit("C3")))).when(n == 4, F.concat(F.unhex(F.lit("FEFF")), text.cast("binary"))).otherwise(F.unhex(F.lit("")))
    )
    rows = read_table(spark, sf_dir, "documents").select("doc_id", made.alias("b"))
    found = rows.select("doc_id", detect.detect_bytes("b").alias("format"), detect.is_pdf("b").alias("is_pdf"))
    return found.withColumns({"mime": formats.mime_type("format"), "display": formats.display_name("format")})


def strip_corpora_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page a fragment, the page, a long page, one of many references, and text without markup."""
    html = F.col("html")
    heavy = F.replace(F.replace(html, F.lit("a"), F.lit("&eacute;")), F.lit("n"), F.lit("&#8212;"))
    kinds = (("fragment", F.substring(html, 1, 68)), ("article", html), ("long", F.repeat(html, 4)), ("references", heavy), ("plain", F.translate(html, "<>", "()")))
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("x")) for k, x in kinds])))
    return rows.select("page_id", "kind", strip_to_text("x").alias("text"))


def _as_files(rows: DataFrame, label: str) -> str:
    """A folder with one file of ``content`` for each ``key``."""
    folder = new_folder(rows.sparkSession, label)
    rows.repartition("key").write.mode("append").partitionBy("key").text(folder)
    return folder


def _file_a_row(rows: DataFrame, label: str) -> str:
    """A folder with one file ``key=<key>.txt`` of a line for each row of ``key, value``."""
    folder = new_folder(rows.sparkSession, label)
    line = F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).cast("binary")
    files.write_files(rows.select(F.concat_ws("", F.lit("key="), F.col("key").cast("string"), F.lit(".txt")).alias("name"), line.alias("content")), folder)
    return folder


def strip_files_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("value"))
    target = f"{new_folder(spark, 'text')}/out"
    documents.strip_files(spark, _file_a_row(pages, "html"), target, compression="gzip")
    return spark.read.text(target).select(F.col("value").alias("text"))


def head_formats_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a page, told by its first 1,024 bytes: pages, PDF, stray bytes, a code point across the bound, text, and one word."""
    html, n = F.col("html"), F.col("page_id") % 6
    made = (
        F.when(n == 0, html).when(n == 1, F.concat(F.lit("%PDF-1.7 "), html)).when(n == 2, F.concat(F.unhex(F.lit("FE")), html.cast("binary")).cast("string"))
        .when(n == 3, F.concat(F.lit("x"), F.repeat(F.lit("é"), 700), html)).when(n == 4, F.translate(html, "<", "(")).otherwise(F.lit("word"))
    )
    rows = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), made.alias("value"))
    found = heads.read_head_formats(spark, _file_a_row(rows, "heads"))
    return found.select(F.regexp_extract("path", "key=(-?[0-9]*)[.]txt$", 1).try_cast("long").alias("page_id"), "length", "bytes_read", "by_path", "by_content")


def fetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of all page addresses, fetched from files that six in seven pages have."""
    pages = read_table(spark, sf_dir, "pages").where("url is not null").groupBy("url").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("page_id"))
    files = _as_files(pages.where("page_id % 7 <> 0").select(F.md5(F.col("url").cast("binary")).alias("key"), "html"), "mirror")

    def name(url: str) -> str:
        import hashlib

        return "key=" + hashlib.md5(url.encode()).hexdigest()

    found = fetch.fetch(pool.pool_of_pages(read_table(spark, sf_dir, "pages")), fetch.from_files(files, name), seconds=30.0)
    results = qa.tested(found.withColumn("text", strip_to_text("html")).withColumnRenamed("cat", "category"), "text")
    return results.select("url", "lang", "category", "html_len", "text_len", (F.col("fetch_ms") >= 0).alias("timed"), F.regexp_extract("error", "^[A-Za-z]+", 0).alias("error"))


def qa_sample_pages(k: int, seed: int, category: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: pool.sample_pool(pool.pool_of_pages(read_table(spark, sf_dir, "pages")), k, seed, category)


def qa_details_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks with their details, of texts as they are, and cut short, broken and scripted by a rule."""
    n, text = F.col("doc_id") % 5, F.col("text")
    odd = _pick(tuple(map(chr, (1, 0x1F, 0xA0, 0x200B, 0xFEFF))), F.col("doc_id"))
    t = F.when(n == 0, text).when(n == 1, F.substring(text, 1, 7)).when(n == 2, F.replace(text, F.lit("e "), F.concat(F.lit("e  "), odd))).when(n == 3, F.concat(text, F.lit(" <B id=k> function( typeof a === b")))
    t = t.otherwise(F.concat(F.lit(" it's \\ \"  k\t"), text))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), F.concat(F.lit("<BODY><Script>"), text).alias("h"))
    return rows.select("doc_id", F.inline(qa.checks("t", "h")))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").withColumn("error", F.when(F.col("page_id") % 11 == 3, "no page"))
    return qa.tested(pages.withColumns({"text": strip_to_text("html"), "lang": F.regexp_extract("url", "^[^:]*://[^/]*/([^/?#]*)", 1)}), "text")


def qa_report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report by the sink that counts while it writes, read back line by line."""
    target = f"{new_folder(spark, 'report')}/out"
    reports.save_report(_results(spark, sf_dir), target, "2026-01-01", 7)
    return spark.read.text(target).where("value <> ''").select(F.col("value").alias("line"))


def qa_observed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that the job which saves the results counts on the way."""
    results, watch = qa.observed(_results(spark, sf_dir))
    results.write.mode("append").parquet(f"{new_folder(spark, 'results')}/out")
    return spark.createDataFrame([tuple(watch.get[c] for c in ("documents", "errors", "checks", "failed_checks"))], "documents long, errors long, checks long, failed_checks long")


def extract_timed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with ``extract_ms`` filled by the job itself."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html", qa.timed(strip_to_text("html"), "text").alias("r"))
    return pages.select("page_id", F.length("r.text").cast("long").alias("text_len"), (F.col("r.ms") > 0).alias("timed"))


def stream_totals_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a stream of page files, per quarter of an hour and language; stopped after half of the files and resumed."""
    folder, target, state = (new_folder(spark, x) for x in ("pages", "totals", "state"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    middle = pages.agg(F.avg("page_id")).first()[0] or 0.0
    schema = pages.schema
    for part in (F.col("page_id") < middle, F.col("page_id") >= middle):
        pages.where(part).repartitionByRange(2, "page_id").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        shaped = stream.withColumns({"text": strip_to_text("html"), "lang": F.regexp_extract("url", "^[^:]*://[^/]*/([^/?#]*)", 1), "error": F.when(F.col("page_id") % 11 == 3, "no page")})
        rows = qa.tested(shaped, "text", keep=["page_id"]).withColumn("at", F.timestamp_seconds("page_id"))
        query = totals.write_totals(totals.windowed_totals(rows, "at", "15 minutes", "30 days"), target, state)
        query.awaitTermination()
    found = totals.read_totals(spark, target)
    return found.withColumn("from_time", F.unix_seconds("from_time"))


def extract_fields_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and extractors alone: the plan has no stripping."""
    fields = read_table(spark, sf_dir, "pages").select("page_id", *extract.extract_fields("html"))
    return fields.select("page_id", "format", "extractor", "fallback")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "strip_rich_pages": strip_rich_pages,
    "strip_rich_pages_wiki": strip_rich_pages_wiki,
    "decode_references_pages": decode_references_pages,
    "cleanup_strange_documents": cleanup_strange_documents,
    "ref_markers_documents": ref_markers_documents,
    "detect_bytes_documents": detect_bytes_documents,
    "strip_corpora_pages": strip_corpora_pages,
    "strip_files_pages": strip_files_pages,
    "head_formats_pages": head_formats_pages,
    "fetch_pages": fetch_pages,
    "extract_fields_pages": extract_fields_pages,
    "qa_sample": qa_sample_pages(200, 11),
    "qa_sample_news": qa_sample_pages(20, 3, "net"),
    "qa_details_documents": qa_details_documents,
    "qa_report_pages": qa_report_pages,
    "qa_observed_pages": qa_observed_pages,
    "extract_timed_pages": extract_timed_pages,
    "stream_totals_pages": stream_totals_pages,
}


def _mark(n: str, shown: str) -> str:
    return f"replace({_picked(MARKS, n)}, '{{}}', ({shown})::VARCHAR)"


def _sample(k: int, seed: int, category: str | None) -> str:
    only = f"WHERE cat = {o.lit(category)}" if category else ""
    return f"""WITH p AS (SELECT DISTINCT url, regexp_extract(url, '^[^:]*://[^/]*/([^/?#]*)', 1) AS lang, regexp_extract(url, '^[^:]*://[^/?#]*?([^./?#]*)(?:[/?#]|$)', 1) AS cat FROM pages WHERE url IS NOT NULL),
c AS (SELECT *, row_number() OVER (ORDER BY url, lang, cat) - 1 AS number, count(*) OVER () AS n FROM p {only}),
d AS (SELECT i AS draw, ('0x' || md5('{seed}:' || i)[1:8])::UBIGINT / 4294967296.0::DOUBLE AS u FROM range({k}) AS r(i))
SELECT draw, url, lang, cat FROM d JOIN c ON c.number = floor(d.u * c.n)"""


def _results_sql() -> str:
    """CTEs up to ``c (page_id, lang, error, name, passed, detail)`` and ``r``, one row a page."""
    checks = " UNION ALL ".join(f"SELECT page_id, {o.lit(n)} AS name, {sql} AS passed, CASE WHEN {sql} THEN '' ELSE {o.detail(n, 'text', 'x')} END AS detail FROM r WHERE error IS NULL" for n, sql in o._checks("text", "x"))
    return f"""WITH {o.strip_cte('SELECT page_id AS id, html AS x FROM pages')},
r AS (SELECT p.page_id, p.url, s.x, t.text, regexp_extract(p.url, '^[^:]*://[^/]*/([^/?#]*)', 1) AS lang, CASE WHEN p.page_id % 11 = 3 THEN 'no page' END AS error
  FROM src s JOIN stripped t ON s.id = t.id JOIN pages p ON p.page_id = s.id),
c AS ({checks}),
n AS (SELECT r.page_id, count(c.name) AS checks, coalesce(count_if(NOT c.passed), 0) AS bad FROM r LEFT JOIN c ON c.page_id = r.page_id GROUP BY 1)"""


def statements() -> dict[str, str]:
    stripped = "SELECT id AS page_id, text FROM stripped"
    kinds = (
        ("fragment", "substr(html, 1, 68)"), ("article", "html"), ("long", "repeat(html, 4)"), ("references", "replace(replace(html, 'a', '&eacute;'), 'n', '&#8212;')"), ("plain", "translate(html, '<>', '()')"),
    )
    corpora = " UNION ALL ".join(f"SELECT page_id * 10 + {i} AS id, {x} AS x FROM pages" for i, (_, x) in enumerate(kinds))
    kind = "[" + ", ".join(o.lit(k) for k, _ in kinds) + "][id % 10 + 1]"
    odd = _chosen((1, 0x1F, 0xA0, 0x200B, 0xFEFF), "doc_id")
    texts = (
        f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 7) WHEN 2 THEN replace(text, 'e ', 'e  ' || {odd}) WHEN 3 THEN text || ' <B id=k> function( typeof a === b'"
        " ELSE ' it''s \\ \"  k' || chr(9) || text END AS t, '<BODY><Script>' || text AS h FROM documents"
    )
    details = " UNION ALL ".join(f"SELECT doc_id, {o.lit(n)} AS name, {sql} AS passed, CASE WHEN {sql} THEN '' ELSE {o.detail(n, 't', 'h')} END AS detail FROM d" for n, sql in o._checks("t", "h"))
    results = _results_sql()
    totals_ = "count(*) AS documents, count(error) AS errors, sum(n.checks)::BIGINT AS checks, sum(n.bad)::BIGINT AS failed_checks FROM r JOIN n ON n.page_id = r.page_id"
    byte_format = f"CASE doc_id % 6 WHEN 0 THEN {o.detect_str('text')} WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' ELSE 'plain_text' END"
    file_ = "CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN '%PDF-1.7 ' || html WHEN 3 THEN 'x' || repeat('é', 700) || html WHEN 4 THEN translate(html, '<', '(') ELSE 'word' END"
    size = f"(CASE WHEN page_id % 6 = 2 THEN octet_length(encode(html)) + 1 ELSE octet_length(encode({file_})) END + 1)"
    return {
        "strip_rich_pages": f"WITH {o.strip_cte(_RICH)} {stripped}",
        "strip_rich_pages_wiki": f"WITH {o.strip_cte(_RICH, True)} {stripped}",
        "decode_references_pages": f"SELECT page_id, input, {o.decode('input')} AS output FROM (SELECT page_id, {references_sql('page_id')} AS input FROM pages)",
        "cleanup_strange_documents": f"SELECT doc_id, {o.cleanup('x')} AS cleaned FROM (SELECT doc_id, replace(text, ' e', {_chosen(STRANGE, 'doc_id')} || ' e') AS x FROM documents)",
        "ref_markers_documents": f"SELECT doc_id, {o.markers('x')} AS text FROM (SELECT doc_id, replace(text, ' ', ' ' || {_mark('doc_id', 'doc_id % 100')} || ' ') AS x FROM documents)",
        "detect_bytes_documents": f"SELECT doc_id, f AS format, doc_id % 6 = 2 AS is_pdf, {o.chosen('f', formats.MIME)} AS mime, {o.chosen('f', formats.DISPLAY)} AS display FROM (SELECT doc_id, {byte_format} AS f FROM documents)",
        "strip_corpora_pages": f"WITH {o.strip_cte(corpora)} SELECT id // 10 AS page_id, {kind} AS kind, text FROM stripped",
        "strip_files_pages": f"WITH {o.strip_cte('SELECT page_id AS id, html || chr(10) AS x FROM pages')} SELECT text FROM stripped",
        "head_formats_pages": f"SELECT page_id, {size} AS length, least({size}, 1024) AS bytes_read, 'plain_text' AS by_path, CASE page_id % 6 WHEN 0 THEN {o.detect_str('html')} WHEN 1 THEN 'pdf' WHEN 2 THEN 'unknown' WHEN 4 THEN {o.detect_str(chr(116) + 'ranslate(html, ' + o.lit('<') + ', ' + o.lit('(') + ')')} ELSE 'plain_text' END AS by_content FROM pages",
        "fetch_pages": f"""WITH one AS (SELECT url, arg_min(html, page_id) AS html, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY 1),
{o.strip_cte("SELECT page_id AS id, html || chr(10) AS x FROM one WHERE page_id % 7 <> 0")}
SELECT one.url, regexp_extract(url, '^[^:]*://[^/]*/([^/?#]*)', 1) AS lang, regexp_extract(url, '^[^:]*://[^/?#]*?([^./?#]*)(?:[/?#]|$)', 1) AS category, coalesce(length(s.x), 0) AS html_len,
  coalesce(length(t.text), 0) AS text_len, true AS timed, CASE WHEN s.id IS NULL THEN 'FileNotFoundError' END AS error FROM one LEFT JOIN src s ON s.id = one.page_id LEFT JOIN stripped t ON t.id = one.page_id""",
        "extract_fields_pages": f"SELECT page_id, f AS format, CASE f WHEN 'html' THEN 'strip' ELSE 'passthrough' END AS extractor, false AS fallback FROM (SELECT page_id, {o.detect_str('html')} AS f FROM pages)",
        "qa_sample": _sample(200, 11, None),
        "qa_sample_news": _sample(20, 3, "net"),
        "qa_details_documents": f"WITH d AS ({texts}) {details}",
        "qa_report_pages": f"""{results}, parts AS (SELECT '# Extraction report' AS line UNION ALL SELECT '- Date: 2026-01-01' UNION ALL SELECT '- Seed: 7' UNION ALL SELECT '- Documents: ' || count(*) FROM r UNION ALL SELECT '## Results'
UNION ALL SELECT '### [' || CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN n.bad > 0 THEN 'FAIL' ELSE 'PASS' END || '] ' || coalesce(lang, '-') || ' ' || url FROM r JOIN n ON n.page_id = r.page_id
UNION ALL SELECT 'Error: ' || error FROM r WHERE error IS NOT NULL
UNION ALL SELECT '- HTML: ' || format('{{:,}}', length(x)) || ' chars, text: ' || format('{{:,}}', length(text)) || ' chars' FROM r WHERE error IS NULL
UNION ALL SELECT '- [' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || '] ' || name || CASE WHEN detail <> '' THEN ': ' || detail ELSE '' END FROM c
UNION ALL SELECT '## Summary' UNION ALL SELECT '- Documents: ' || count(*) FROM r UNION ALL SELECT '- Errors: ' || count(error) FROM r UNION ALL SELECT '- Checks: ' || count(*) FROM c UNION ALL SELECT '- Failed checks: ' || count_if(NOT passed) FROM c)
SELECT unnest(string_split(line, chr(10))) AS line FROM parts""",
        "qa_observed_pages": f"{results} SELECT {totals_}",
        "extract_timed_pages": f"WITH {o.strip_cte('SELECT page_id AS id, html AS x FROM pages')} SELECT id AS page_id, length(text) AS text_len, true AS timed FROM stripped",
        "stream_totals_pages": f"{results} SELECT r.page_id // 900 * 900 AS from_time, lang, {totals_} GROUP BY 1, 2",
    }
