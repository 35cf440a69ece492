"""One file a row, written by the tasks that hold the rows: ``write_files``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Files of one folder.
FOLDER = 1000


class FileWriter(DataSourceArrowWriter):
    """Each attempt of a task fills a folder of its own; the commit, of one row a task, removes those of lost attempts."""

    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path if self.path.startswith("/") else self.path.replace("file:/", "file:///", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, top = self._place()
        told = WriterCommitMessage()
        told.folder = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        folder, number, names = "", 0, set()
        for batch in iterator:
            for name, content in zip(batch["name"].to_pylist(), batch["content"]):
                if not folder or len(names) == self.files or name in names:
                    folder, number, names = f"{top}/{told.folder}/{number:06d}", number + 1, set()
                    store.create_dir(folder, recursive=True)
                names.add(name)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.as_buffer() or b"")
        return told

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = self._place()
        kept = {m.folder for m in messages if m is not None}
        for found in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if found.base_name.startswith("part-") and found.base_name not in kept:
                store.delete_dir(found.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = self._place()
        for m in messages:
            if m is not None and store.get_file_info(f"{top}/{m.folder}").type == fs.FileType.Directory:
                store.delete_dir(f"{top}/{m.folder}")


class SingleFiles(DataSource):
    """Options: ``path`` (of a file system that pyarrow knows), ``files`` a folder (1000).  Takes ``name`` and ``content``."""

    @classmethod
    def name(cls) -> str:
        return "single_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], int(self.options.get("files", FOLDER)))


def write_files(rows: DataFrame, path: str, files: int = FOLDER) -> None:
    """Write ``content`` (binary; null: no bytes) of every row of ``name, content`` to a file called ``name``.

    The folder is new or empty.  Files lie two folders deep, at most ``files`` in one;
    rows of one name are files of one name in different folders.  One pass, without a
    shuffle; nothing is moved when the job ends.
    """
    rows.sparkSession.dataSource.register(SingleFiles)
    rows.select("name", "content").write.format("single_files").option("path", path).option("files", files).mode("append").save()
