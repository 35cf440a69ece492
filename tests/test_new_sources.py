"""Heads of files, fetching, reports in one pass, draws from pools, totals of streams."""

import time

import pytest
from pyspark.sql import functions as F

from loomtext.operators import qa
from loomtext.operators.strip import strip_to_text
from loomtext.sources import fetch, heads, pool, reports
from loomtext.streaming import totals


def test_heads(spark, tmp_path):
    cut = ("x" + "é" * 600).encode()
    files = {"a.html": b"<html>" + b"k" * 5000, "b.pdf": b"%PDF-1.4" + b"\xff" * 3000, "c": b"", "d.md": b"\xffk", "e": cut, "f": cut[:1024], "g/h.txt": b"word", "_hidden": b"k", ".k/l": b"k"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r.path[len(str(tmp_path)) + 1 :]: (r.length, r.bytes_read, r.by_path, r.by_content) for r in heads.read_head_formats(spark, str(tmp_path)).collect()}
    assert rows == {
        "a.html": (5006, 1024, "html", "html"), "b.pdf": (3008, 1024, "pdf", "pdf"), "c": (0, 0, "unknown", "plain_text"), "d.md": (2, 2, "markdown", "unknown"),
        "e": (1201, 1024, "unknown", "plain_text"), "f": (1024, 1024, "unknown", "unknown"), "g/h.txt": (4, 4, "plain_text", "plain_text"),
    }
    assert heads.read_heads(spark, str(tmp_path), files=2).rdd.getNumPartitions() == 4
    (tmp_path / "none").mkdir()
    assert heads.read_heads(spark, str(tmp_path / "none")).count() == 0


def test_fetch(spark):
    def answer(url, seconds):
        if url == "slow":
            time.sleep(30)
        if url == "bad":
            raise ValueError("no such page")
        return url + "/", f"<p>{url}</p>"

    df = spark.createDataFrame([("a", 1), ("slow", 2), ("bad", 3), (None, 4), ("b", 5), ("b", 5)], "url string, k int").coalesce(1)
    began = time.time()
    rows = fetch.fetch(df, answer, seconds=1.5, at_once=2, tasks=1).collect()
    assert time.time() - began < 25
    got = sorted((r.k, r.final_url, r.html, r.error, r.fetch_ms is not None) for r in rows)
    assert got == [
        (1, "a/", "<p>a</p>", None, True), (2, None, None, "TimeoutError: no answer in 1.5 s", True), (3, None, None, "ValueError: no such page", True), (4, None, None, "no address", False),
        (5, "b/", "<p>b</p>", None, True), (5, "b/", "<p>b</p>", None, True),
    ]
    results = qa.tested(spark.createDataFrame(rows).withColumn("text", strip_to_text("html")), "text")
    assert qa.summary(results, error="error").first().errors == 3
    assert fetch.fetch(df.limit(0), answer).count() == 0


def _results(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("error", F.when(F.col("page_id") % 4 == 1, "none"))
    return qa.tested(pages.withColumn("text", strip_to_text("html")), "text")


def test_report_in_one_pass(spark, sf_dir, tmp_path):
    results = _results(spark, sf_dir).repartition(3)
    (tmp_path / "r").mkdir()
    reports.save_report(results, str(tmp_path / "r"), "2026-01-01", 7)
    files = sorted(p.name for p in (tmp_path / "r").iterdir())
    assert files[0] == "a-head.md" and files[-1] == "z-summary.md" and len(files) == 5
    text = "".join((tmp_path / "r" / f).read_text() for f in files)
    row = qa.summary(results, error="error").first()
    assert text.startswith("# Extraction report") and text.count("\n### ") == row.documents - text.startswith("### ")
    assert text.endswith(f"- Errors: {row.errors}\n- Checks: {row.checks}\n- Failed checks: {row.failed_checks}\n")
    with pytest.raises(FileExistsError):
        reports.save_report(results, str(tmp_path / "r"), "2026-01-01")
    reports.save_report(results.limit(0), str(tmp_path / "empty"), "2026-01-01")
    assert "- Documents: 0\n" in (tmp_path / "empty/z-summary.md").read_text()


def test_lost_attempts_leave_no_sections(tmp_path):
    writer = reports.ReportWriter(str(tmp_path), "d", "1")
    (tmp_path / "part-000000-lost.md").write_text("k")
    told = reports.WriterCommitMessage()
    told.file, told.counts = "part-000000-kept.md", dict.fromkeys(("documents", "errors", "checks", "failed_checks"), 2)
    (tmp_path / told.file).write_text("k")
    writer.commit([told, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a-head.md", "part-000000-kept.md", "z-summary.md"]
    writer.abort([told, None])
    assert not (tmp_path / told.file).exists()


def test_observed_totals(spark, sf_dir):
    results, watch = qa.observed(_results(spark, sf_dir))
    results.write.format("noop").mode("overwrite").save()
    assert tuple(watch.get[c] for c in ("documents", "errors", "checks", "failed_checks")) == tuple(qa.summary(_results(spark, sf_dir), error="error").first())


def test_time_of_a_row(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select("html", qa.timed(strip_to_text(F.repeat("html", 20)), "text").alias("long"), qa.timed(F.lit(1)).alias("short")).collect()
    assert all(r.long.ms > 0 for r in rows) and sum(r.long.ms for r in rows) > 5 * sum(r.short.ms for r in rows)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_draws_do_not_depend_on_partitions(spark, parts):
    rows = [(f"u{i % 400:03}", None if i % 9 else "en", "ab"[i % 2]) for i in range(500)] + [(None, None, "a")]
    df = spark.createDataFrame(rows, "url string, lang string, cat string").repartition(parts)
    order = sorted(rows, key=lambda r: tuple((x is not None, x or "") for x in r))
    got = sorted(pool.sample_pool(df, 50, 7).collect())
    u = {r.id: r.u for r in spark.range(50).select("id", pool.drawn(7, F.col("id")).alias("u")).collect()}
    assert [tuple(r[1:]) for r in got] == [order[int(u[i] * len(order))] for i in range(50)]
    assert {r.cat for r in pool.sample_pool(df, 30, 1, "b").collect()} == {"b"}
    assert pool.sample_pool(df.limit(0), 5, 1).count() == 0


def test_totals_of_a_stream_that_stops(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("lang", F.concat(F.lit("l"), F.col("page_id") % 3))
    shaped = pages.select("page_id", "html", "lang", F.timestamp_seconds(F.col("page_id") * 60).alias("at"))
    folder = str(tmp_path / "pages")

    def results(rows):
        return qa.tested(rows.withColumn("text", strip_to_text("html")), "text", keep=["at"])

    for half in (F.col("page_id") < 12, F.col("page_id") >= 12):
        shaped.where(half).repartition(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(shaped.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        totals.write_totals(totals.windowed_totals(results(stream), "at", "5 minutes"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = sorted(map(tuple, totals.read_totals(spark, str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, totals.windowed_totals(results(shaped), "at", "5 minutes").collect()))
