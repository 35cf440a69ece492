"""Wiki reference markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_column
from .constants import MARKERS


def strip_ref_markers(text: Column | str) -> Column:
    """Remove ``[12]``, ``[edit]``, ``[citation needed]`` and a bare ``edit]``.

    ``edit]`` glued to a letter or digit stays, and with it the text up to the next
    ``[``.  Null stays null.
    """
    return F.regexp_replace(as_column(text), F.lit(MARKERS), F.lit("$1"))
