"""Many small files: written one a row, read whole."""

import pytest
from helpers import compared
from pyspark.sql import functions as F

from loomtext.plans import derived
from loomtext.sources import documents, files, heads


def _below(folder):
    return sorted(p for p in folder.rglob("*") if p.is_file())


def test_one_file_a_row(spark, tmp_path):
    rows = [(f"k{i}", bytearray(b"\xff" * i)) for i in range(25)] + [("k3", bytearray(b"twin")), ("none", None)]
    files.write_files(spark.createDataFrame(rows, "name string, content binary").coalesce(2), f"file:{tmp_path}/out", files=10)
    got = sorted((p.name, p.read_bytes()) for p in _below(tmp_path / "out"))
    assert got == sorted((n, bytes(c or b"")) for n, c in rows)
    assert all(len(list(d.iterdir())) <= 10 for d in (tmp_path / "out").glob("*/*"))
    files.write_files(spark.createDataFrame([], "name string, content binary"), f"{tmp_path}/empty")
    assert not _below(tmp_path / "empty")


def test_folders_of_lost_attempts_go(tmp_path):
    writer = files.FileWriter(f"file:{tmp_path}", 10)
    told = files.WriterCommitMessage()
    told.folder = "part-000000-kept"
    for name in ("part-000000-kept/000000", "part-000000-lost/000000"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "k").write_text("k")
    writer.commit([told, None])
    assert [p.name for p in tmp_path.iterdir()] == ["part-000000-kept"]
    writer.abort([told, None])
    assert not list(tmp_path.iterdir())


def test_strip_of_many_files(spark, tmp_path):
    """As many tasks as keep the cores busy, not one for some thirty files; the same rows as by Spark's own source."""
    for i in range(700):
        place = tmp_path / "in" / f"{i % 7}" / f"k{i}.html"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(b"<p>caf\xc3\xa9 \xff &amp; <b>%d</b>\n" % i)
    for name in ("_hidden", ".hidden", "0/k._COPYING_"):
        (tmp_path / "in" / name).write_text("hidden")
    (tmp_path / "in/_a=b").write_text("shown")
    documents.strip_files(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    got = sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    assert got == sorted([f"café � & {i}" for i in range(700)] + ["shown"])
    assert len(list((tmp_path / "out").glob("part-*"))) <= 4 * spark.sparkContext.defaultParallelism
    assert documents.read_texts(spark, f"{tmp_path}/in").count() == 701
    documents.strip_files(spark, f"{tmp_path}/in", f"{tmp_path}/packed", compression="gzip")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/packed").collect()) == got
    assert all(p.suffix == ".gz" for p in (tmp_path / "packed").glob("part-*"))


@pytest.mark.parametrize("source", ["in/*.html", "in/a.html"])
def test_strip_of_patterns_and_single_files(spark, tmp_path, source):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<p>a")
    (tmp_path / "in/b.txt").write_text("<p>b")
    documents.strip_files(spark, f"{tmp_path}/{source}", f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["a"]


def test_tasks_of_whole_files(tmp_path, monkeypatch):
    for i in range(12):
        (tmp_path / f"k{i:02}").write_bytes(b"k" * (3000 if i == 5 else 400))

    def parts(size, files, tasks=1):
        return [len(p.value[1]) for p in heads.HeadReader(f"file:{tmp_path}", size, files, tasks).partitions()]

    assert parts(1024, 1000) == [12] and parts(1024, 1000, 4) == [3] * 4 and parts(1024, 5) == [5, 5, 2]
    monkeypatch.setattr(heads, "TASK_BYTES", 1000)
    assert parts(1 << 20, 1000) == [2, 2, 1, 1, 2, 2, 2]
    monkeypatch.setattr(heads, "BATCH_BYTES", 1000)
    reader = heads.HeadReader(f"file:{tmp_path}", 1 << 20, 1000)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["path"], r["length"], len(r["head"])) for r in rows] == [(f"{tmp_path}/k{i:02}", n, n) for i, n in enumerate([400] * 5 + [3000] + [400] * 6)]


def test_pages_as_files_share_folders(spark, tmp_path):
    """One file a page, but no folder a page."""
    rows = spark.range(500).select(F.col("id").alias("key"), F.when(F.col("id") > 0, "<p>k").alias("value")).coalesce(2)
    folder = derived._file_a_row(rows, "pages")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("content").cast("string").alias("c")).collect()
    assert sorted((r.path.rpartition("/")[2], r.c) for r in found) == sorted((f"key={i}.txt", "<p>k\n" if i else "\n") for i in range(500))
    assert len({r.path.rpartition("/")[0] for r in found}) == 2


def test_heads_of_pages_share_folders(spark, tmp_path, monkeypatch):
    """Far fewer folders than pages; ids below zero and none at all are those of the table."""
    import duckdb

    pages = [(i, None, f"<html>{i}") for i in [*range(300), -5, None]]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/sf/pages.parquet")
    monkeypatch.setattr(derived, "new_folder", lambda spark, label: f"file:{tmp_path}/{label}")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/sf/pages.parquet/*.parquet'")
    ours, theirs = compared(derived.head_formats_pages(spark, f"{tmp_path}/sf"), con, derived.statements()["head_formats_pages"])
    assert ours == theirs and len(ours) == 302
    assert len([p for p in (tmp_path / "heads").rglob("*") if p.is_dir()]) <= 2 * spark.sparkContext.defaultParallelism
