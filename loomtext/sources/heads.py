"""The first bytes of files, as a Python data source: ``spark.read.format("file_heads").load(path)``."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import formats as f
from ..functions.common import as_column
from ..functions.detect import detect_path, is_html, is_pdf
from .shared import file_system

#: Bytes that detection looks at, files and bytes that one task reads at most (one file at least), and those of one batch.
HEAD, FILES, TASK_BYTES = 1024, 1000, 128 << 20
BATCH_FILES, BATCH_BYTES = 100, 4 << 20


def _hidden(part: str) -> bool:
    return part[:1] == "." or part[:1] == "_" and "=" not in part or part.endswith("._COPYING_")


class HeadReader(DataSourceReader):
    def __init__(self, path: str, size: int, files: int, tasks: int = 1):
        self.path, self.size, self.files, self.tasks = path, size, files, tasks

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path if self.path.startswith("/") else self.path.replace("file:/", "file:///", 1))

    def partitions(self) -> list[InputPartition]:
        """Names of files, in order, as what they begin with alike and the rest of each; names that Spark's own readers hide are left out."""
        store, top = self._place()
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        kept = sorted((x.path, min(self.size, x.size or 0)) for x in found if x.is_file and not any(_hidden(part) for part in x.path[len(top) :].split("/") if part))
        most = max(1, min(self.files, -(-len(kept) // self.tasks)))
        parts, names, size = [], [], 0
        for name, length in kept:
            if names and (len(names) == most or size + length > TASK_BYTES):
                parts.append(names)
                names, size = [], 0
            names.append(name)
            size += length
        alike = [(os.path.commonprefix(part), part) for part in [*parts, names]]
        return [InputPartition((start, [name[len(start) :] for name in part])) for start, part in alike]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """One ranged read a file; the rest of it is not touched."""
        store, _ = self._place()
        start, names = partition.value
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("head", pa.binary())])
        rows, size = [], 0
        for name in names:
            with store.open_input_file(start + name) as file:
                length = file.size()
                rows.append({"path": start + name, "length": length, "head": file.read_at(min(self.size, length), 0)})
            size += min(self.size, length)
            if len(rows) == BATCH_FILES or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class FileHeads(DataSource):
    """Options: ``path`` (a folder of a file system that pyarrow knows), ``bytes`` (1024), ``files`` a task at most (1000), ``tasks`` at least if there are as many files (1)."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options["path"], int(self.options.get("bytes", HEAD)), int(self.options.get("files", FILES)), int(self.options.get("tasks", 1)))


def read_heads(spark: SparkSession, path: str, size: int = HEAD, files: int = FILES, tasks: int = 1) -> DataFrame:
    """``path, length, head`` of the files below a folder, of which only the first ``size`` bytes are read."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("bytes", size).option("files", files).option("tasks", tasks).load(path)


def known_folder(spark: SparkSession, path: str) -> str | None:
    """Full address of a folder that pyarrow can list; null for a pattern, a single file, and a store that only Spark reaches."""
    files, target = file_system(spark, path)
    address = files.makeQualified(target).toString()
    try:
        store, top = HeadReader(address, HEAD, FILES)._place()
        return address if store.get_file_info(top).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def detect_head(head: Column | str, length: Column | str) -> Column:
    """Format by the first bytes of content of ``length`` bytes: as ``detect_bytes`` says, but ``unknown`` only if the head is not UTF-8.

    A code point that the end of the head cuts is not held against it.  Null stays null.
    """
    value, size = as_column(head), F.octet_length(as_column(head))
    cuts = [F.is_valid_utf8(F.substring(value, F.lit(1), size - k).cast("string")) for k in range(4)]
    valid = cuts[0] | ((as_column(length) > size) & (cuts[1] | cuts[2] | cuts[3]))
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(size == 0, F.lit(f.PLAIN_TEXT))
        .when(is_pdf(value), F.lit(f.PDF))
        .when(~valid, F.lit(f.UNKNOWN))
        .when(is_html(F.make_valid_utf8(value.cast("string"))), F.lit(f.HTML))
        .otherwise(F.lit(f.PLAIN_TEXT))
    )


def read_head_formats(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, bytes_read, by_path, by_content`` of files."""
    heads = read_heads(spark, path)
    return heads.select("path", "length", F.octet_length("head").cast("long").alias("bytes_read"), detect_path("path").alias("by_path"), detect_head("head", "length").alias("by_content"))
