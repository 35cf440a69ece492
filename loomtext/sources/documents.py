"""Documents from and to files; only Spark's readers and writers touch a path, but for folders that ``strip_files`` reads by pyarrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import detect_bytes, detect_path
from ..operators.pdf import try_extract_pdf_bytes
from ..operators.strip import StripOptions, strip_to_text
from .heads import known_folder, read_heads

#: Bytes that a value may have; a longer file is an error, not a cut text.
_MOST_BYTES = (1 << 31) - 1


def _text(content: str) -> Column:
    return F.make_valid_utf8(F.col(content).cast("string"))


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, content`` (string) of whole files; bytes that are no UTF-8 become U+FFFD."""
    return read_bytes(spark, path, glob).select("path", _text("content").alias("content"))


def read_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, length, content`` (binary) of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def read_formats(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, by_path, by_content`` of files."""
    return read_bytes(spark, path, glob).select("path", detect_path("path").alias("by_path"), detect_bytes("content").alias("by_content"))


def extract_pdf_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """``path, value, error`` of PDF files."""
    return read_bytes(spark, path, glob).select("path", try_extract_pdf_bytes("content").alias("r")).select("path", "r.*")


def strip_files(spark: SparkSession, source: str, target: str, options: StripOptions | None = None, compression: str = "none") -> None:
    """Read HTML files, write one line of text for each.

    A folder that pyarrow can list is read by the source of heads, with a thousand files a
    task and no list of files in the driver's JVM; all else by Spark's source of whole files.
    ``compression`` is one of Spark's text writer, such as ``gzip``.
    """
    folder = known_folder(spark, source)
    if folder:
        files = read_heads(spark, folder, _MOST_BYTES, tasks=4 * spark.sparkContext.defaultParallelism)
        whole = F.when(F.col("length") == F.octet_length("head"), F.col("head")).otherwise(F.raise_error(F.concat(F.lit("too long: "), "path")))
        texts = files.select(whole.alias("content")).select(_text("content").alias("content"))
    else:
        texts = read_texts(spark, source)
    stripped = texts.select(strip_to_text("content", options).alias("value"))
    stripped.write.mode("errorifexists").text(target, compression=compression)


def write_report(lines: DataFrame, target: str) -> None:
    """Write a report (``place, value``, see ``operators.qa.report``); files in the order of their names hold it in order."""
    lines.orderBy("place", "value").select("value").write.mode("errorifexists").text(target)
