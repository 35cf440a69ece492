"""Exclusive running totals over a whole table in id order, without one task that sees all rows.

Ids are cut into ranges of ``2**10`` neighbouring values, rows without an id into ranges
of their first tie breaker.  Totals per range are summed again over ranges of ranges (20
more bits each time), so every window is bounded by the width of its range and not by
the number of rows; only rows of one id, or without one and of one size, share a range
however many there are.  All of it is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits dropped from the id at each level; the last level has at most 2**14 ranges.
LEVELS = (10, 30, 50)
#: First range of rows without an id, bits of the tie breaker in one, and most of them: all below every real range.
_NO_ID, _TIE_BITS, _TIE_RANGES = -(1 << 60), 6, 1 << 24


def _range_of(id_column: str, tie: str) -> Column:
    tied = F.least(F.greatest(F.shiftright(F.col(tie).cast("long"), _TIE_BITS), F.lit(0)), F.lit(_TIE_RANGES))
    return F.coalesce(F.shiftright(F.col(id_column), LEVELS[0]), F.lit(_NO_ID) + F.coalesce(tied, F.lit(0)))


def _running(measures: list[str], window) -> list[Column]:
    return [F.sum(m).over(window) - F.col(m) for m in measures]


def with_prefix(rows: DataFrame, id_column: str, measures: list[str], ties: list[str]) -> DataFrame:
    """Add ``before_<m>`` and ``total_<m>`` (long) for each measure.

    ``rows`` must be cheap to read twice (a written table).  Order: ``id_column``
    ascending with nulls first, then ``ties``; rows equal in all of these are
    interchangeable.  Measures must not be null.  An empty table stays empty.
    """
    keys = [f"__range{i}" for i in range(len(LEVELS))]
    tables = [rows.groupBy(_range_of(id_column, ties[0]).alias(keys[0])).agg(*[F.sum(m).alias(m) for m in measures])]
    for i in range(1, len(LEVELS)):
        step = LEVELS[i] - LEVELS[i - 1]
        tables[-1] = tables[-1].withColumn(keys[i], F.shiftright(keys[i - 1], step))
        tables.append(tables[-1].groupBy(keys[i]).agg(*[F.sum(m).alias(m) for m in measures]))

    top, whole = tables[-1], Window.orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    offsets = top.select(
        keys[-1],
        *[c.alias(f"before_{m}") for m, c in zip(measures, _running(measures, whole))],
        *[F.sum(m).over(every).alias(f"total_{m}") for m in measures],
    )
    for i in range(len(LEVELS) - 2, -1, -1):
        inner = Window.partitionBy(keys[i + 1]).orderBy(keys[i]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = tables[i].select(keys[i], keys[i + 1], *[c.alias(f"__in_{m}") for m, c in zip(measures, _running(measures, inner))])
        offsets = local.join(offsets, keys[i + 1]).select(
            keys[i],
            *[(F.col(f"__in_{m}") + F.col(f"before_{m}")).alias(f"before_{m}") for m in measures],
            *[f"total_{m}" for m in measures],
        )
    order = [F.col(id_column).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ties]]
    inner = Window.partitionBy(keys[0]).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn(keys[0], _range_of(id_column, ties[0]))
    placed = reduce(lambda df, mc: df.withColumn(f"__in_{mc[0]}", mc[1]), zip(measures, _running(measures, inner)), placed)
    return placed.join(offsets, keys[0]).select(
        *[F.col(c) for c in rows.columns],
        *[(F.col(f"__in_{m}") + F.col(f"before_{m}")).alias(f"before_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )
