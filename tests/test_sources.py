from pyspark.sql import functions as F

from loomtext.operators.strip import strip_to_text
from loomtext.plans.catalogue import sample_pdf
from loomtext.sources import documents
from loomtext.streaming import pages


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<h1>Rain <u>and</u>\n&amp; wind</h1>")
    (tmp_path / "in/b.pdf").write_bytes(sample_pdf(["In PDF"]))
    (tmp_path / "in/c.txt").write_bytes(b"caf\xc3\xa9 \xff")
    formats = {r.path.rpartition("/")[2]: (r.by_path, r.by_content) for r in documents.read_formats(spark, str(tmp_path / "in")).collect()}
    assert formats == {"a.html": ("html", "html"), "b.pdf": ("pdf", "pdf"), "c.txt": ("plain_text", "unknown")}
    rows = documents.extract_pdf_files(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 1 and rows[0].value.text == "In PDF\n" and rows[0].error is None
    texts = {r.path.rpartition("/")[2]: r.content for r in documents.read_texts(spark, str(tmp_path / "in"), "*.txt").collect()}
    assert texts == {"c.txt": "café �"}
    (tmp_path / "html").mkdir()
    (tmp_path / "html/a.html").write_text("<h1>Rain <u>and</u>\n&amp; wind</h1>")
    documents.strip_files(spark, str(tmp_path / "html"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["Rain and & wind"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "pages"))
    stream = pages.read_pages(spark, str(tmp_path / "pages"), files_per_batch=1)
    query = pages.write_extracted(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r.page_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).select("page_id", "extracted.text").collect()}
    want = {r.page_id: r.t for r in source.select("page_id", strip_to_text("html").alias("t")).collect()}
    assert got == want
    assert pages.with_extraction(source).where(F.col("extracted.format") != "html").count() == 0
