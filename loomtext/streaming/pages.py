"""Extraction over streams.  All operators are stateless, so no watermark or state store is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract


def read_pages(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet page tables that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_extraction(pages: DataFrame, column: str = "html", using: Callable[[Column | str], Column] = extract) -> DataFrame:
    """The stream or table with a result struct ``extracted`` instead of the source column."""
    return pages.withColumn("extracted", using(column)).drop(column)


def write_extracted(pages: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append extraction results to Parquet, exactly once; ``availableNow=True`` by default."""
    writer = with_extraction(pages).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
