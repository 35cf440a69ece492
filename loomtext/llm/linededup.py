"""Line dedup: keep a repeated line only in the first document that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The text's lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _document_key(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Id, lines and the fingerprint that tells rows of one id apart."""
    text = F.col(text_column)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("print"),
    )


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10) -> DataFrame:
    """Per document that loses lines: ``doc_id, print, keep_gaps``.

    ``keep_gaps`` is the document's keep bitmap, compressed: before each dropped
    line, in order, the number of lines kept since the dropped line before it.

    Hashes of line keys (128 bits) are range-partitioned and sorted by document
    and position inside a range.  A key is dealt over as many streams as there
    are shuffle partitions, by its document's hash, so a line that a third of
    all documents hold fills no partition.  Each stream passes on its first
    document; later ones lose the line at once.  Then the few keys that several
    streams hold are settled among their first documents.
    """
    spark = docs.sparkSession
    streams = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.transform(
        lines_of(F.col("text")),
        lambda line: F.transform(
            F.array(line_key(line)),
            lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"))),
        )[0],
    )
    rows = (
        _document_key(docs, id_column, text_column)
        .where("doc_id is not null")
        .select("doc_id", "print", F.posexplode(hashed).alias("pos", "key"))
        .where("key is not null")
        .select("key.h", "key.g", "doc_id", "print", "pos")
    )
    rows = cut(rows, "line-hashes").withColumn("stream", F.pmod(F.xxhash64("doc_id"), F.lit(streams)).cast("int"))
    stream = Window.partitionBy("h", "g", "stream").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = rows.repartitionByRange(streams, "h", "g", "stream").withColumn("first_doc", F.first("doc_id").over(stream))
    streamed = cut(streamed, "line-streams")
    shared = (
        streamed.where("doc_id = first_doc").groupBy("h", "g")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most").select("h", "g", "least")
    )
    late = streamed.where("doc_id > first_doc").select("doc_id", "print", "pos")
    settled = streamed.where("doc_id = first_doc").join(shared, ["h", "g"]).where("doc_id > least").select("doc_id", "print", "pos")
    positions = F.array_sort(F.collect_set("pos"))
    return (
        late.unionByName(settled).groupBy("doc_id", "print").agg(positions.alias("gone"))
        .select("doc_id", "print", F.transform("gone", lambda p, i: F.when(i == 0, p).otherwise(p - F.get("gone", i - 1) - 1)).alias("keep_gaps"))
    )


def keep_flags(keep_gaps: Column) -> Column:
    """The bitmap as far as its last dropped line, one '1' or '0' for each line."""
    bits = F.array_join(F.transform(keep_gaps, lambda g: F.concat(F.repeat(F.lit("1"), g), F.lit("0"))), "")
    return F.split(bits, "")


def kept_text(text: Column, keep_gaps: Column) -> Column:
    lines = F.zip_with(lines_of(text), keep_flags(keep_gaps), lambda line, flag: F.when(flag == "0", F.lit(None)).otherwise(line))
    return F.when(keep_gaps.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))


def _marked(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under neutral column names with ``keep_gaps``, and the neutral name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    gone = dropped_lines(docs, id_column, text_column, min_chars).toDF("gone_id", "gone_print", "keep_gaps")
    text = F.coalesce(F.col(names[text_column]), F.lit(""))
    same = (F.col(names[id_column]).cast("long") == F.col("gone_id")) & (F.xxhash64(text) == F.col("gone_print"))
    return plain.join(gone, same, "left").select(*names.values(), "keep_gaps"), names


def line_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10) -> DataFrame:
    """Every row of ``docs`` with ``keep_gaps`` (null: all lines stay).

    A line's key is the line without blanks at both ends, A-Z lower-cased.  Keys
    of ``min_chars`` or more code points lose all lines but those in the smallest
    id that holds them.

    Null or empty text: one empty line, which stays.  Rows with a null id neither
    hold nor lose lines.  Rows of one id count as one document; equal rows lose
    the same lines.  Empty table: no rows.  All columns are kept, of whatever name;
    one named ``keep_gaps`` is replaced.
    """
    marked, names = _marked(docs, id_column, text_column, min_chars)
    return marked.select(*[F.col(n).alias(c) for c, n in names.items() if c != "keep_gaps"], "keep_gaps")


def without_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with the dropped lines taken out of the text; columns as before, of whatever name.

    Lines are dropped as ``line_bitmaps`` says.  A null text comes back empty, a text
    that loses all lines too.  Rows with a null id stay as they are, equal rows stay
    equal.  Empty table: no rows.
    """
    marked, names = _marked(docs, id_column, text_column, min_chars)
    return marked.select(*[(kept_text(F.col(n), F.col("keep_gaps")) if c == text_column else F.col(n)).alias(c) for c, n in names.items()])


def line_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row, lines dropped as ``line_bitmaps`` says.

    Null or empty text: one line, none dropped, the digest of an empty text.  Null
    ids, repeated rows and empty tables as there; other columns are not read.
    """
    marked = line_bitmaps(docs.select("doc_id", "text"))
    return marked.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("keep_gaps"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("keep_gaps")).cast("binary"), 256).alias("kept_sha256"),
    )
