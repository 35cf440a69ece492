"""Helpers for building expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row."""
    return F.transform(F.array(value), use)[0]


def ascii_lower(value: Column) -> Column:
    return F.translate(value, _UPPER, _LOWER)


def literal_map(table: dict[str, str]) -> Column:
    """A constant map, given as one literal that the optimizer folds; building it takes one call, not one an entry."""
    text = "\x02".join(f"{key}\x01{value}" for key, value in table.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))
