"""Format detection from strings, bytes and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats as f
from .common import as_column, let
from .constants import WHITE

# What a PDF starts with, and extensions of each format.
_MAGIC = b"%PDF"
EXTENSIONS = {
    f.HTML: ("html", "htm", "xhtml"),
    f.PDF: ("pdf",),
    f.MARKDOWN: ("md", "markdown", "mkd"),
    f.PLAIN_TEXT: ("txt", "text"),
}


def starts_with_tag(text: Column | str) -> Column:
    """``<`` and an ASCII letter at the start."""
    return as_column(text).rlike("^<[A-Za-z]")


def is_html(text: Column | str) -> Column:
    """Whether the first 1,024 bytes look like HTML.  Null stays null."""
    head = F.make_valid_utf8(F.substring(as_column(text).cast("binary"), 1, 1024).cast("string"))
    trimmed = F.regexp_replace(head, F.lit(f"^[{WHITE}]+"), F.lit(""))

    def marked(w: Column) -> Column:
        starts = [F.startswith(w, F.lit(p)) for p in ("<!", "<html", "<HTML", "<?xml")]
        both = F.contains(w, F.lit("<head")) & F.contains(w, F.lit("<body"))
        return starts[0] | starts[1] | starts[2] | starts[3] | both | (starts_with_tag(w) & F.contains(w, F.lit("</")))

    return let(trimmed, marked)


def is_pdf(content: Column | str) -> Column:
    """Whether the bytes start with the PDF magic number.  Null stays null."""
    return F.substring(as_column(content), 1, 4) == F.lit(_MAGIC)


def detect_str(text: Column | str) -> Column:
    """``html`` or ``plain_text``.  Null stays null."""
    value = as_column(text)
    return F.when(value.isNull(), F.lit(None).cast("string")).when(is_html(value), F.lit(f.HTML)).otherwise(F.lit(f.PLAIN_TEXT))


def detect_bytes(content: Column | str) -> Column:
    """``plain_text`` (also for no bytes), ``pdf``, ``html``, or ``unknown`` if not UTF-8.  Null stays null."""
    value = as_column(content)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.octet_length(value) == 0, F.lit(f.PLAIN_TEXT))
        .when(is_pdf(value), F.lit(f.PDF))
        .when(F.is_valid_utf8(value.cast("string")), detect_str(value.cast("string")))
        .otherwise(F.lit(f.UNKNOWN))
    )


def detect_path(path: Column | str) -> Column:
    """Format by the path's last extension; a leading dot starts none.  Null stays null."""
    value = as_column(path)
    plain = F.regexp_replace(value, F.lit("(?:/\\.?)+$"), F.lit(""))
    name = F.regexp_extract(plain, "([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, "^(?s:.+)\\.([^.]*)$", 1))

    def known(e: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for fmt, names in EXTENSIONS.items():
            out = out.when(e.isin(*names), F.lit(fmt))
        return out.otherwise(F.lit(f.UNKNOWN))

    return F.when(value.isNotNull(), let(extension, known))
