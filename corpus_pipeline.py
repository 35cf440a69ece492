"""The corpus pipeline: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import fertility, linededup, mixing, neardup, pieces
from loomtext.llm import vocabularies as v
from loomtext.llm.scratch import cut
from loomtext.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility band of their language or script.

    Null, empty and short texts go.  Null ids or languages, ties and repeated rows are
    judged row by row; extra columns of any name stay.  Empty table: no rows.
    """
    return fertility.passing(docs, v.PIECES, v.BYTE_RANKS, v.BYTE_PATTERN)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; ``n_chars`` follows the text.

    Null texts come back empty.  Rows without an id neither hold nor lose lines; rows of
    one id count as one document, and equal rows stay equal.  Empty table: no rows.
    """
    return linededup.without_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies (similarity 0.8).

    Of repeated rows one stays, rows without an id are compared by their texts and yield to
    rows with one, texts without words stay.  Empty table: no rows.
    """
    return neardup.without_near_copies(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their token targets.

    Null sources and languages are categories of their own.  Null and empty texts have no
    tokens and are drawn like their cell.  Equal rows share a draw, rows without an id
    are drawn by text.  Columns of any name stay, ``mix`` too.  Targets are met within
    0.1 %, with a smaller share of the tokens if need be; what still misses is logged.
    Empty table: no rows.
    """
    return mixing.drawn_to_targets(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids, lossless`` of every document: piece ids, decoded again and compared with the text.

    Null and empty texts have no ids.  Rows without an id are drawn as id 0, equal rows
    have equal ids.  Empty table: no rows.
    """
    return pieces.encode_checked(docs, v.PIECES)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing to targets", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # tokenisers, sketches and draws are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
