"""Sharding: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import with_prefix
from .scratch import cut

#: Bytes that a row takes beside its text, and shards up to which the table of them is broadcast.
ROW_OVERHEAD, FEW_SHARDS = 8, 100_000


def row_size(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def balanced_shards(docs: DataFrame, n_shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Assign every row to one of ``n_shards`` shards by the law ``bytes``.

    Rows stand in id order.  Sizes are summed per range of ids, the range totals
    are summed over the whole table, and a row goes to the shard in which the
    middle of its bytes lies when the total is cut at ``n_shards`` equal targets.
    A shard's size thus differs from the target by less than its largest rows.
    Only ids, sizes and checksums are shuffled, never texts.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; ``slot``
    counts a shard's rows from 0 in id order.  ``grown_shard`` is null under this
    law, and equal texts are not kept together.

    Null text: size of an empty one.  Null ids come first.  Rows with one id are
    ordered by size and checksum; fully equal rows are interchangeable.  Empty
    table: no rows.  Other columns of ``docs``, of whatever name, are not read.
    """
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        row_size(text_column).alias("size"),
        F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = with_prefix(cut(narrow, "shard-rows"), "doc_id", ["size", "one"], ["size", "text_crc32"])
    wide = "decimal(38,0)"
    shard = F.expr(f"cast(least(((cast(before_size as {wide}) * 2 + size) * {n_shards}) div (total_size * 2), {n_shards - 1}L) as int)")
    placed = cut(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.col("before_one").alias("place")), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # n_shards rows
    return placed.join(F.broadcast(first) if n_shards <= FEW_SHARDS else first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
