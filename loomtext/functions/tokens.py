"""Markup tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_column, let
from .constants import MARKUP_TOKEN, TAG_NAME


def markup_tokens(html: Column | str) -> Column:
    """``array<string>`` of comments, directives, tags and text that tile the input.  Null stays null."""
    return F.regexp_extract_all(as_column(html), F.lit(MARKUP_TOKEN), F.lit(0))


def token_kind(token: Column) -> Column:
    return (
        F.when(~F.startswith(token, F.lit("<")), F.lit("text"))
        .when(F.startswith(token, F.lit("<!--")), F.lit("comment"))
        .when(F.startswith(token, F.lit("<!")), F.lit("directive"))
        .otherwise(F.lit("tag"))
    )


def tag_name(token: Column) -> Column:
    """Lower-cased name of a tag, ``/`` included; empty for other tokens.  Names beyond ASCII stay as they are."""
    name = F.regexp_extract(token, TAG_NAME, 1)
    return let(name, lambda n: F.when(F.octet_length(n) == F.char_length(n), F.lower(n)).otherwise(n))
