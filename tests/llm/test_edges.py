"""Nulls, repeated rows and ids, clashing names and empty tables, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from loomtext.llm import components, fertility, linededup, mixing, neardup, pieces, scratch, secrets, sharding, substring, tokenfile
from loomtext.llm import vocabularies as v

OPERATORS = {
    "tokens": lambda df: tokenfile.token_digests(df, v.WORD_BPE),
    "near": lambda df: neardup.near_duplicates(df, 85),
    "secrets": secrets.secret_digest,
    "substring": substring.duplicate_spans,
    "mixing": mixing.mix_to_targets,
    "pieces": lambda df: pieces.encode_checked(df, v.PIECES),
    "sharding": lambda df: sharding.balanced_shards(df, 24),
    "quality": lambda df: fertility.quality(df, v.PIECES, v.BYTE_RANKS, v.BYTE_PATTERN),
    "lines": linededup.line_bitmaps,
    "line_digest": linededup.line_digest,
}


@pytest.fixture(scope="module")
def results(odd_frame):
    return {name: run(odd_frame).collect() for name, run in OPERATORS.items()}


def test_every_row_has_a_result(results, odd_frame):
    n = odd_frame.count()
    assert {name: len(rows) for name, rows in results.items()} == {name: n for name in OPERATORS}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, odd_frame):
    assert OPERATORS[name](odd_frame.limit(0)).count() == 0


def test_near_dedup_of_odd_rows(results):
    rows = results["near"]
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id in (2, 3, -5)} == {-5}  # all sets of an id belong together
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id == 1} == {(0, 1)}
    assert {r.component_id for r in rows if r.doc_id in (2**62, -(2**62))} == {-(2**62)}


def test_lines_of_odd_rows(results):
    by = {(r.doc_id, r.text): r.keep_gaps for r in results["lines"]}
    assert all(gaps is None for (d, _), gaps in by.items() if d is None)
    assert [gaps for (d, t), gaps in by.items() if d == 3] == [[0]]  # id 2 holds the line first
    assert all(gaps is None for (d, _), gaps in by.items() if d == 2)


def test_substrings_of_odd_rows(results):
    rows = results["substring"]
    assert all(r.n_removed == r.n_words for r in rows if r.doc_id == 3)
    assert sorted(r.n_words for r in rows if r.doc_id == 1) == [0, 0]


def test_shards_of_odd_rows(results):
    slots = {}
    for r in results["sharding"]:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_tokens_of_odd_rows(results):
    rows = sorted(results["tokens"], key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert [r.doc_id is None for r in rows[:2]] == [True, True] and rows[-1].doc_id == 2**62


def test_mixing_keeps_columns(results, odd_frame):
    assert results["mixing"][0].__fields__ == [*odd_frame.columns, "mix"]
    assert all(r.lossless for r in results["pieces"])
    assert all(not r.kept for r in results["quality"] if r.n_words < 50)


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, odd_frame, empty):
    docs = odd_frame.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars", "size")
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("not lossless").count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a"), (1, text, "b"), (None, text, "c"), (None, text + " alone", "d"), (None, "other words stand here in a row of their own", "e")]
    rows += [(None, "other words stand here in a row of their own", "f"), (7, "", "g"), (7, "", "h"), (None, None, "i"), (None, None, "j"), (9, "k", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_id string")
    kept = [r.row_id for r in neardup.without_near_copies(df, 80).collect()]
    assert sorted(x for x in kept if x in "ghijk") == list("ghijk")
    assert sum(x in "ab" for x in kept) == 1 and "c" not in kept and "d" not in kept and sum(x in "ef" for x in kept) == 1


def test_token_files_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, ""), (-1, "a b")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for n, frame in ((5, docs), (0, docs.limit(0))):
        path = scratch.new_folder(spark, "odd")
        tokenfile.write_token_files(frame, path, v.WORD_BPE)
        rows = tokenfile.read_token_files(spark, path).collect()
        assert len(rows) == n
        assert {r.doc_id: r.ids for r in rows}.get(3, [1]) == [1]
        assert sorted(str(r.doc_id) for r in rows if len(r.ids) > 1) == ["-1", "None", "None"][:n]


def test_decoding_of_odd_rows(spark):
    rows = [(None, None), (1, []), (2, None), (None, []), (1, [])]
    encoded = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit("clash"))
    got = pieces.decode(encoded, v.PIECES)
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={d}, text='')" for d, _ in rows)
    assert pieces.decode(encoded.limit(0), v.PIECES).count() == 0


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 3), (None, 4), (4, None), (None, None), (2, -7)], "a long, b long").withColumn("root", F.lit("clash"))
    assert sorted(map(tuple, components.components(edges).collect())) == [(1, -7), (2, -7)]
    assert components.components(edges.limit(0)).count() == 0


def test_topics_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "some words")], "doc_id long, text string").withColumn("words", F.lit("clash"))
    assert len(mixing.fit_topics(docs)) <= mixing.TOPICS
    empty = mixing.fit_topics(docs.limit(0))
    assert len(empty) == 1 and not empty.any()
