"""Attributes of a tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_column
from .constants import attribute


def attribute_text(tag: Column | str, name: str) -> Column:
    """Value of the first ``name=``, or an empty string."""
    value, pattern = as_column(tag), attribute(name)
    return F.concat(*[F.regexp_extract(value, pattern, i) for i in (1, 2, 4)])


def attribute_value(tag: Column | str, name: str) -> Column:
    """Value of the first ``name=`` that follows the start, a blank, a quote or ``<``.

    Null if there is none or its quote is not closed.  Null stays null.
    """
    value = as_column(tag)
    open_quote = F.regexp_extract(value, attribute(name), 3)
    return F.when(value.rlike(attribute(name)) & (open_quote == ""), attribute_text(value, name))
