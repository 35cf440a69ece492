"""White space and invisible characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_column, let
from .constants import CHANGED_ASCII_SPACES, CHANGED_SPACES, DROPPED, UNUSUAL


def cleanup_whitespace(text: Column | str) -> Column:
    """Drop controls and invisible characters, make runs of white space one space, trim.

    A dropped character does not break a run.  Null stays null.  Texts of plain
    characters alone, told by one cheap pattern, take a shorter way to the same result.
    """

    def cleaned(value: Column) -> Column:
        plain = F.regexp_replace(value, F.lit(CHANGED_ASCII_SPACES), F.lit(" "))
        full = F.regexp_replace(F.regexp_replace(value, F.lit(DROPPED), F.lit("")), F.lit(CHANGED_SPACES), F.lit(" "))
        return F.btrim(F.when(value.rlike(UNUSUAL), full).otherwise(plain), F.lit(" "))

    return cleaned(as_column(text)) if isinstance(text, str) else let(as_column(text), cleaned)
