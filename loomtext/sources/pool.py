"""Seeded draws from a pool of page addresses: a table ``url, lang, cat``, however large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Bits of a row's number within its partition.
_INNER = 33


def pool_of_pages(pages: DataFrame) -> DataFrame:
    """``url, lang, cat`` of the different addresses of a table of pages: the first folder of the path, and the host's last label."""
    known = pages.select("url").where("url is not null").distinct()
    lang, cat = F.regexp_extract("url", "^[^:]*://[^/]*/([^/?#]*)", 1), F.regexp_extract("url", "^[^:]*://[^/?#]*?([^./?#]*)(?:[/?#]|$)", 1)
    return known.select("url", lang.alias("lang"), cat.alias("cat"))


def drawn(seed: int, i: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the row's number alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), i).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def numbered(pool: DataFrame, *order: str) -> DataFrame:
    """The rows with ``number``, their place from 0 in the order of the columns, nulls first; no task sees them all.

    Rows are range-partitioned and sorted, written with their place in the partition,
    and get the sum of the partitions before: one narrow row a partition.
    """
    placed = pool.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = stored(placed, "placed").withColumn("_part", F.shiftright("_place", _INNER))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    inner = F.col("_place").bitwiseAND(F.lit((1 << _INNER) - 1))
    return placed.join(starts.drop("_rows"), "_part").withColumn("number", F.col("_start") + inner).drop("_part", "_place", "_start")


def sample_pool(pool: DataFrame, k: int, seed: int, category: str | None = None) -> DataFrame:
    """``draw, url, lang, cat``: exactly ``k`` draws with replacement, of one category if given.

    The same draws come from any partitioning: a draw names a place in the order of
    addresses (see ``numbered``), and places and draws meet by an equi-join.  A pool
    without rows gives none; null addresses come first, repeated ones count each.
    """
    chosen = pool if category in (None, "all") else pool.where(F.col("cat") == category)
    placed = stored(numbered(chosen.select("url", "lang", "cat"), "url", "lang", "cat"), "pool")
    size = placed.count()
    draws = pool.sparkSession.range(k).select(F.col("id").alias("draw"), F.floor(drawn(seed, F.col("id")) * size).alias("number"))
    return placed.join(draws, "number").select("draw", "url", "lang", "cat")
