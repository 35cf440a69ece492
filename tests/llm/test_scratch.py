"""Intermediate tables: where they go and when they are freed; file sizes; clashing names."""

import os
import subprocess
import sys
import types
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.llm import linededup, neardup, scratch, tokenfile
from loomtext.llm import vocabularies as v

ROOT = Path(__file__).resolve().parents[2]


def tables(spark):
    place = scratch.shared_dir(spark).removeprefix("file:")
    return set(os.listdir(place))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: None), sparkContext=context)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(session)


def test_scope_frees_tables(spark):
    before = tables(spark)
    with scratch.scope(spark):
        kept = neardup.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).where("kept").count()
        assert kept == 1 and tables(spark) - before
    assert tables(spark) == before


def test_tables_go_with_the_driver_even_after_stop(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\n"
        "from loomtext.llm import scratch\n"
        f"spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        "assert scratch.cut(spark.range(3), 'x').count() == 3\n"
        "spark.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, timeout=120)
    assert not [x for x in os.listdir(tmp_path) if x.startswith("x-")]


def test_many_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 50)
    monkeypatch.setattr(tokenfile, "FILE_SEGMENTS", 2)
    monkeypatch.setattr(tokenfile, "slices", lambda batch, *_: (batch.slice(i, 10) for i in range(0, batch.num_rows, 10)))
    docs = spark.range(400).selectExpr("id as doc_id", "concat('some words and number ', id) as text").coalesce(2)
    path = scratch.new_folder(spark, "many")
    tokenfile.write_token_files(docs, path, v.WORD_BPE)
    files = [x for x in os.listdir(path.removeprefix("file:")) if x.startswith("part-")]
    assert len(files) > 10
    got = tokenfile.read_token_files(spark, path).groupBy().agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    assert tuple(got) == (400, 400)


def test_a_tokenizer_across_words_is_refused():
    from public_tokenizers import path

    with pytest.raises(ValueError, match="word by word"):
        tokenfile.WordEncoder(path("byte_bpe_50k.json"))


def test_lines_keep_columns_of_clashing_names(spark):
    line = "a line that is long enough"
    names = ["doc_id", "text", "__keep", "__id", "__print", "keep_gaps", "gone_id", "gone_print", "c0", "c1", "print", "pos", "h", "g"]
    rows = [(i, f"{line}\nown {i}", *[f"{n}{i}" for n in names[2:]]) for i in range(3)]
    df = spark.createDataFrame(rows, names)
    out = linededup.without_repeated_lines(df)
    assert out.columns == names
    assert {tuple(r) for r in out.collect()} == {(i, t if i == 0 else f"own {i}", *rest) for i, t, *rest in rows}
    marked = linededup.line_bitmaps(df)
    assert marked.columns == [*[n for n in names if n != "keep_gaps"], "keep_gaps"] and {r["__id"] for r in marked.collect()} == {"__id0", "__id1", "__id2"}
