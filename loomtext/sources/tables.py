"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, small_bytes: int = 256 << 20) -> DataFrame:
    """A table; one of fewer splits than cores is dealt out anew if its files have at most ``small_bytes``.

    Larger tables are read as they are, without a shuffle, however many cores there
    are; ``spark.sql.files.maxPartitionBytes`` sets the size of their splits.
    """
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if found.rdd.getNumPartitions() >= cores:
        return found
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return found.repartition(cores) if files.getContentSummary(path).getLength() <= small_bytes else found
