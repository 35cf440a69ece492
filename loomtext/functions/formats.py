"""Document formats, the result record and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_column

PLAIN_TEXT, HTML, PDF, MARKDOWN, UNKNOWN = "plain_text", "html", "pdf", "markdown", "unknown"

# Media types, names and messages.
MIME = {
    PLAIN_TEXT: "text/plain", HTML: "text/html", PDF: "application/pdf", MARKDOWN: "text/markdown",
    UNKNOWN: "application/octet-stream",
}
DISPLAY = {PLAIN_TEXT: "plain text", HTML: "HTML", PDF: "PDF", MARKDOWN: "Markdown", UNKNOWN: "unknown"}
UNSUPPORTED, IO_ERROR, EMPTY_RESULT = "unsupported_format", "io", "empty_result"
MESSAGES = {
    UNSUPPORTED: "unsupported format: ", IO_ERROR: "I/O error: ", EMPTY_RESULT: "extraction produced no text",
}

#: What every extractor returns.
EXTRACTED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("extractor", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("fallback", T.BooleanType()),
    ]
)
#: What the ``try_`` extractors return: one of the two is null.
ERROR = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "message", "cause")])
ATTEMPT = T.StructType([T.StructField("value", EXTRACTED), T.StructField("error", ERROR)])


def _chosen(fmt: Column | str, names: dict[str, str]) -> Column:
    value = as_column(fmt)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, name in names.items():
        out = out.when(value == key, F.lit(name))
    return out


def mime_type(fmt: Column | str) -> Column:
    """Media type of a format; null for null or no format."""
    return _chosen(fmt, MIME)


def display_name(fmt: Column | str) -> Column:
    """Readable name of a format; null for null or no format."""
    return _chosen(fmt, DISPLAY)


def extracted(text: Column, fmt: Column | str, extractor: Column | str, title: Column | None = None, excerpt: Column | None = None, fallback: Column | bool = False) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        text.alias("text"),
        (fmt if isinstance(fmt, Column) else F.lit(fmt)).alias("format"),
        (extractor if isinstance(extractor, Column) else F.lit(extractor)).alias("extractor"),
        (none if title is None else title).alias("title"),
        (none if excerpt is None else excerpt).alias("excerpt"),
        (fallback if isinstance(fallback, Column) else F.lit(fallback)).alias("fallback"),
    )


def error(kind: str, detail: Column | str = "", cause: Column | None = None) -> Column:
    """``kind``, the ``message`` in words, and as ``cause`` what another reader said, null if none did."""
    message = F.concat(F.lit(MESSAGES[kind]), detail if isinstance(detail, Column) else F.lit(detail))
    return F.struct(F.lit(kind).alias("kind"), message.alias("message"), (F.lit(None).cast("string") if cause is None else cause).alias("cause"))


def attempt(value: Column | None = None, failure: Column | None = None) -> Column:
    return F.struct(
        (F.lit(None).cast(EXTRACTED) if value is None else value.cast(EXTRACTED)).alias("value"),
        (F.lit(None).cast(ERROR) if failure is None else failure.cast(ERROR)).alias("error"),
    )
