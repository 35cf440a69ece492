"""Extraction by format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import formats as f
from ..functions.common import as_column, let
from ..functions.detect import detect_str
from .strip import strip_to_text

#: What the error says about PDF.
PDF_NEEDS_BYTES = "PDF needs the file's bytes: use extract_pdf_files() or extract_pdf_bytes()"


def _record(content: Column, fmt: Column) -> Column:
    is_html = fmt == f.HTML
    return f.extracted(
        F.when(is_html, strip_to_text(content)).otherwise(content), fmt, F.when(is_html, F.lit("strip")).otherwise(F.lit("passthrough"))
    )


def _format(fmt: Column | str) -> Column:
    return F.lit(fmt) if isinstance(fmt, str) and fmt in f.MIME else as_column(fmt)


def extract(content: Column | str) -> Column:
    """Result struct of ``content`` by its detected format.  Null stays null."""
    value = as_column(content)
    return F.when(value.isNotNull(), let(detect_str(value), lambda fmt: _record(value, fmt)))


def extract_fields(content: Column | str) -> list[Column]:
    """The fields of ``extract`` as columns of their own: those that a query does not read are not worked out.

    ``pages.select("page_id", *extract_fields("html")).select("format")`` strips nothing.  Null
    content gives nulls.
    """
    value = as_column(content)
    fmt = detect_str(value)
    known, none = fmt.isNotNull(), F.lit(None).cast("string")
    return [
        F.when(fmt == f.HTML, strip_to_text(value)).otherwise(value).alias("text"), fmt.alias("format"),
        F.when(known, F.when(fmt == f.HTML, "strip").otherwise("passthrough")).alias("extractor"), none.alias("title"), none.alias("excerpt"), F.when(known, False).alias("fallback"),
    ]


def try_extract(content: Column | str) -> Column:
    """``struct<value, error>`` of ``extract``, which has no error of its own."""
    return f.attempt(extract(content))


def extract_as(content: Column | str, fmt: Column | str) -> Column:
    """Result struct by the format given (a name or a column); ``pdf`` raises an error.

    Null content or format gives null.
    """
    value, kind = as_column(content), _format(fmt)
    refused = F.raise_error(F.lit(f.MESSAGES[f.UNSUPPORTED] + PDF_NEEDS_BYTES)).cast(f.EXTRACTED)
    return F.when(value.isNull() | kind.isNull(), F.lit(None).cast(f.EXTRACTED)).when(kind == f.PDF, refused).otherwise(_record(value, kind))


def try_extract_as(content: Column | str, fmt: Column | str) -> Column:
    """``struct<value, error>``: like ``extract_as``, with the error as a value."""
    value, kind = as_column(content), _format(fmt)
    refused = f.attempt(failure=f.error(f.UNSUPPORTED, PDF_NEEDS_BYTES))
    return (
        F.when(value.isNull() | kind.isNull(), f.attempt())
        .when(kind == f.PDF, refused)
        .otherwise(f.attempt(_record(value, kind)))
    )
