"""Where intermediate tables live.

Lineage is cut by writing a Parquet table to the shared folder that the session
names in ``spark.checkpoint.dir`` (see ``sources.shared``); every executor can read it
again after any other executor is lost.  A table goes when its ``scope`` ends, when
``release`` is called, and at the latest when the driver's JVM ends, also after
``spark.stop()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.shared import discard, new_folder, scope, shared_dir

_PLACE = "_loomtext_place"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a reader of that table."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("append").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    setattr(table, _PLACE, path)
    return table


def release(table: DataFrame) -> None:
    """Remove a table that ``cut`` returned and that nothing will read again."""
    discard(table.sparkSession, getattr(table, _PLACE))


__all__ = ["cut", "new_folder", "release", "scope", "shared_dir"]
