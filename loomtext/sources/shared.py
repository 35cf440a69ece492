"""Folders that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of the open scopes, innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only a session on the driver's own machine (master ``local``) may do without: it
    gets a temporary folder.  Elsewhere the executors would each write to a disk of
    their own, so an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomtext-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as its own kind."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of a fresh name, made at once so that the file system removes it at the JVM's end."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    files, target = file_system(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    files, target = file_system(spark, path)
    files.delete(target, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder once and return a reader of it; lost executors read it again."""
    path = new_folder(df.sparkSession, label)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at its end, the folders that were made inside it; results must be saved by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)
