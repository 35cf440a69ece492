"""Invariants of extracted text, one row per check, and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.common import as_column, let

# Script needles, tags and characters that the checks look for.
SCRIPT_NEEDLES = ("function(", "window.", "document.", "addEventListener", "typeof ", "===")
STANDARD_TAGS = (
    "script|style|div|span|p|a|b|i|em|strong|h[1-6]|table|tr|td|th|ul|ol|li|nav|header|footer|aside|form|img|br|hr|"
    "section|article|main|blockquote|code|pre|head|body|html|meta|link|title|input|button|select|option|textarea|"
    "iframe|noscript|template|svg"
)
TAG = f"(?i)<(?:{STANDARD_TAGS})\\b[^>]*>"
EDGE_SPACE = "[\\t-\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"
INVISIBLE = (
    "[\\x{A0}\\x{AD}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{2066}-\\x{2069}\\x{FE0F}\\x{FEFF}]"
)
#: Fields of a tested document.
RESULT = (
    "url string, final_url string, lang string, category string, html_len bigint, text_len bigint, fetch_ms double, "
    "extract_ms double, checks array<struct<name:string,passed:boolean,detail:string>>, error string"
)


def _shown(text: Column) -> Column:
    """The text in quotes, with escapes for line ends, tabs and backslashes."""
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _code_points(text: Column, pattern: str) -> Column:
    """The first five characters of a pattern, as a list of code points."""
    hits = F.slice(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), 1, 5)
    # big-endian UTF-16 of a character of the basic plane is its number
    names = F.transform(hits, lambda c: F.concat(F.lit("'U+"), F.hex(F.encode(c, "UTF-16BE")), F.lit("'")))
    return F.concat(F.lit("found: ["), F.array_join(names, ", "), F.lit("]"))


def checks(text: Column | str, html: Column | str) -> Column:
    """``array<struct<name, passed, detail>>`` of the seven invariants.  Null in either gives nulls in ``passed``."""
    t, h = as_column(text), as_column(html)
    low = F.lower(h)
    hits = sum((F.contains(t, F.lit(n)).cast("int") for n in SCRIPT_NEEDLES), F.lit(0))
    found_tag = F.regexp_extract(t, f"({TAG})", 1)
    at = F.locate("  ", t) - 1
    around = t.substr(F.greatest(at - 20, F.lit(0)) + 1, F.least(at, F.lit(20)) + 20)
    passed = {
        "no_double_spaces": (~F.contains(t, F.lit("  ")), F.concat(F.lit("at pos "), at, F.lit(": ..."), _shown(around), F.lit("..."))),
        "trimmed": (~t.rlike(f"^{EDGE_SPACE}|{EDGE_SPACE}\\z"), F.lit("leading/trailing whitespace")),
        "no_script_leak": (~(F.contains(low, F.lit("<script")) & (hits >= 3)), F.concat(hits, F.lit(" JS keywords in output"))),
        "no_html_tags": (~t.rlike(TAG), F.concat(F.lit("tag: "), F.substring(found_tag, 1, 60))),
        "non_empty": (
            ~(F.contains(low, F.lit("<body")) & (F.length(h) > 200) & (F.length(t) < 10)),
            F.concat(F.lit("html="), F.length(h), F.lit(" chars, text="), F.length(t), F.lit(" chars")),
        ),
        "no_control_chars": (~t.rlike(CONTROLS), _code_points(t, CONTROLS)),
        "no_invisible_chars": (~t.rlike(INVISIBLE), _code_points(t, INVISIBLE)),
    }
    return F.array(
        *[F.struct(F.lit(n).alias("name"), ok.alias("passed"), F.when(ok, F.lit("")).otherwise(why).alias("detail")) for n, (ok, why) in passed.items()]
    )


def tested(pages: DataFrame, text: Column | str, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Fields of ``RESULT`` for a table of fetched pages and their text.

    ``url``, ``final_url``, ``lang``, ``category``, ``fetch_ms``, ``extract_ms`` and
    ``error`` are taken from columns of these names, null where there is none: a
    projection measures no time for a row (see ``timed``).  A row with an error has no
    checks.  Columns to ``keep`` follow.
    """
    fields = {x.split()[0]: x.split()[1] for x in RESULT.split(", ") if not x.startswith("checks")}
    given = {n: F.col(n).cast(kind) if n in pages.columns else F.lit(None).cast(kind) for n, kind in fields.items()}
    value, source = as_column(text), F.col(html)
    given["html_len"], given["text_len"] = (F.coalesce(F.length(x), F.lit(0)).cast("bigint") for x in (source, value))
    none = F.array().cast("array<struct<name:string,passed:boolean,detail:string>>")
    found = F.when(given["error"].isNull() & source.isNotNull(), checks(value, source)).otherwise(none)
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pages.select(*[(found if n == "checks" else given[n]).alias(n) for n in names], *(keep or []))


def summary(results: DataFrame, column: str = "checks", error: str | None = None) -> DataFrame:
    """One row: ``documents, errors, checks, failed_checks``; counts are combined on the map side."""
    failed = F.size(F.filter(column, lambda c: ~c["passed"]))
    errors = F.count_if(F.col(error).isNotNull()) if error else F.lit(0).cast("bigint")
    return results.agg(
        F.count("*").alias("documents"),
        (errors if error else F.coalesce(F.max(errors), F.lit(0).cast("bigint"))).alias("errors"),
        F.coalesce(F.sum(F.size(column)), F.lit(0)).cast("bigint").alias("checks"),
        F.coalesce(F.sum(failed), F.lit(0)).cast("bigint").alias("failed_checks"),
    )


def observed(results: DataFrame, name: str = "totals") -> tuple[DataFrame, Observation]:
    """``results`` and the totals that the first job over them counts on the way: ``observation.get`` has the fields of ``summary``."""
    watch = Observation(name)
    failed = F.size(F.filter("checks", lambda c: ~c["passed"]))
    counts = [
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.sum(F.size("checks")), F.lit(0)).cast("bigint").alias("checks"), F.coalesce(F.sum(failed), F.lit(0)).cast("bigint").alias("failed_checks"),
    ]
    return results.observe(watch, *counts), watch


def timed(value: Column, name: str = "value") -> Column:
    """``struct<name, ms>``: a value and the milliseconds that working it out took, by two readings of the executor's clock."""
    clock = "java.lang.System"
    read = F.struct(
        F.java_method(F.lit(clock), F.lit("nanoTime")).cast("bigint").alias("began"), value.alias(name), F.java_method(F.lit(clock), F.lit("nanoTime")).cast("bigint").alias("ended")
    )
    return let(read, lambda r: F.struct(r[name].alias(name), ((r["ended"] - r["began"]) / 1e6).alias("ms")))


def exit_status(totals: DataFrame) -> DataFrame:
    """``status``: 1 if a check failed or a document had an error, else 0."""
    return totals.select(F.when((F.col("failed_checks") > 0) | (F.col("errors") > 0), 1).otherwise(0).alias("status"))


def assert_clean(totals: DataFrame) -> None:
    """Fail the job if a check failed or a document had an error."""
    row = totals.first()
    if totals.transform(exit_status).first()["status"]:
        raise AssertionError(f"{row['failed_checks']} failed checks, {row['errors']} errors")


def report_lines(results: DataFrame, others: list[str] | None = None) -> DataFrame:
    """``value``: a Markdown section for each tested document (fields of ``RESULT``), and other columns if asked for."""
    ok = F.forall("checks", lambda c: c["passed"])
    status = F.when(F.col("error").isNotNull(), "ERROR").when(ok, "PASS").otherwise("FAIL")

    def line(c: Column) -> Column:
        detail = F.when(c["detail"] != "", F.concat(F.lit(": "), c["detail"])).otherwise("")
        return F.concat(F.lit("- ["), F.when(c["passed"], "PASS").otherwise("FAIL"), F.lit("] "), c["name"], detail)

    sizes = F.concat(F.lit("- HTML: "), F.format_number("html_len", 0), F.lit(" chars, text: "), F.format_number("text_len", 0), F.lit(" chars"))
    times = F.concat(F.lit("- Fetch: "), F.round("fetch_ms").cast("long"), F.lit(" ms, extract: "), F.round("extract_ms").cast("long"), F.lit(" ms"))
    body = F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error"))).otherwise(F.concat_ws("\n", sizes, times, F.transform("checks", line)))
    title = F.concat(F.lit("### ["), status, F.lit("] "), F.coalesce("lang", F.lit("-")), F.lit(" "), F.coalesce("final_url", "url", F.lit("-")))
    return results.select(F.concat(title, F.lit("\n\n"), body, F.lit("\n")).alias("value"), *(others or []))


def report(results: DataFrame, date: str, seed: int | None = None) -> DataFrame:
    """``place, value``: the whole report, in the order of ``place``: a head, a section for each document, the totals."""
    totals = summary(results, error="error")
    head = F.concat(F.lit(f"# Extraction report\n\n- Date: {date}\n- Seed: {seed}\n- Documents: "), F.col("documents"), F.lit("\n\n## Results\n"))
    lines = [("Documents", "documents"), ("Errors", "errors"), ("Checks", "checks"), ("Failed checks", "failed_checks")]
    foot = F.concat_ws("\n", F.lit("## Summary\n"), *[F.concat(F.lit(f"- {name}: "), F.col(c)) for name, c in lines])
    sections = report_lines(results).select(F.lit(1).alias("place"), "value")
    return totals.select(F.lit(0).alias("place"), head.alias("value")).unionByName(sections).unionByName(totals.select(F.lit(2).alias("place"), foot.alias("value")))
