"""Reports written in one pass: a data source writer whose commit adds head and totals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.qa import report_lines

_COUNTS = ("documents", "errors", "checks", "failed_checks")


class ReportWriter(DataSourceWriter):
    """Each task writes one file of sections and tells its counts; the commit, of one row a task, writes the rest once."""

    def __init__(self, path: str, date: str, seed: str):
        self.path, self.date, self.seed = path, date, seed

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, top = self._place()
        store.create_dir(top, recursive=True)
        told = WriterCommitMessage()
        told.file = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.md"
        told.counts = dict.fromkeys(_COUNTS, 0)
        with store.open_output_stream(f"{top}/{told.file}") as out:
            for row in iterator:
                out.write(row["value"].encode() + b"\n")
                told.counts["documents"] += 1
                for name in _COUNTS[1:]:
                    told.counts[name] += row[name]
        return told

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = self._place()
        told = [m for m in messages if m is not None]
        kept = {m.file for m in told}
        for found in store.get_file_info(fs.FileSelector(top)) if told else []:
            if found.base_name.startswith("part-") and found.base_name not in kept:
                store.delete_file(found.path)  # of attempts that were lost
        store.create_dir(top, recursive=True)
        totals = {name: sum(m.counts[name] for m in told) for name in _COUNTS}
        head = f"# Extraction report\n\n- Date: {self.date}\n- Seed: {self.seed}\n- Documents: {totals['documents']}\n\n## Results\n\n"
        names = dict(zip(_COUNTS, ("Documents", "Errors", "Checks", "Failed checks")))
        foot = "## Summary\n\n" + "".join(f"- {names[n]}: {totals[n]}\n" for n in _COUNTS)
        for name, content in (("a-head.md", head), ("z-summary.md", foot)):
            with store.open_output_stream(f"{top}/{name}") as out:
                out.write(content.encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = self._place()
        for m in messages:
            if m is not None:
                store.delete_file(f"{top}/{m.file}")


class ExtractionReport(DataSource):
    """Options: ``path``, ``date``, ``seed``.  Takes ``value`` and the counts of each row."""

    @classmethod
    def name(cls) -> str:
        return "extraction_report"

    def schema(self) -> str:
        return "value string, errors int, checks int, failed_checks int"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options["path"], self.options.get("date", ""), self.options.get("seed", "None"))


def report_rows(results: DataFrame) -> DataFrame:
    """``value, errors, checks, failed_checks`` of each tested document (fields of ``qa.RESULT``)."""
    failed = F.size(F.filter("checks", lambda c: ~c["passed"]))
    counted = results.withColumns({"_errors": F.col("error").isNotNull().cast("int"), "_checks": F.size("checks"), "_failed": failed})
    return report_lines(counted, ["_errors", "_checks", "_failed"]).toDF("value", "errors", "checks", "failed_checks")


def save_report(results: DataFrame, target: str, date: str, seed: int | None = None) -> None:
    """Write the report of tested documents: one pass over them, no sort; files in the order of their names hold it.

    Sections stand in the order of the table's partitions.  Head and totals come from what
    the tasks tell, so nothing is counted twice.  A folder with files is refused.
    """
    store, top = ReportWriter(target, "", "")._place()
    if store.get_file_info(top).type != fs.FileType.NotFound and store.get_file_info(fs.FileSelector(top)):
        raise FileExistsError(target)
    results.sparkSession.dataSource.register(ExtractionReport)
    report_rows(results).write.format("extraction_report").option("path", target).option("date", date).option("seed", str(seed)).mode("append").save()
