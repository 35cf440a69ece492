"""Totals of tested documents over streams: state per window and language, restartable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_COUNTS = ("documents", "errors", "checks", "failed_checks")


def windowed_totals(results: DataFrame, time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``from_time, lang, documents, errors, checks, failed_checks`` per window of event time and language.

    ``results`` has the fields of ``qa.RESULT`` and a timestamp; a table or a stream.  A
    stream holds the sums of windows that rows at most ``late`` behind the latest may
    still change; later rows are left out.  Null times have no window.
    """
    failed = F.size(F.filter("checks", lambda c: ~c["passed"]))
    rows = results.select(F.col(time).alias("at"), "lang", "error", F.size("checks").alias("n"), failed.alias("bad")).withWatermark("at", late)
    sums = rows.groupBy(F.window("at", width).alias("w"), "lang").agg(
        F.count("*").alias("documents"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("n").cast("long").alias("checks"), F.sum("bad").cast("long").alias("failed_checks")
    )
    return sums.select(F.col("w.start").alias("from_time"), "lang", *_COUNTS)


def write_totals(totals: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the windows that each batch changes to a folder of the batch's number; a batch that is run again writes the same folder.

    ``availableNow=True`` by default.  Stopped and started with the same checkpoint, it goes on where it was.
    """

    def save(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(**(trigger or {"availableNow": True})).start()


def read_totals(spark: SparkSession, target: str) -> DataFrame:
    """The latest totals of each window and language."""
    rows = spark.read.parquet(target)
    latest = rows.groupBy("from_time", "lang").agg(F.max_by(F.struct(*_COUNTS), "batch").alias("t"))
    return latest.select("from_time", "lang", "t.*")
