"""Token-id output: encode a table's texts, write id files in id order, read them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blockfile import decode_segments, encode_segment
from .prefix import with_prefix
from .scratch import cut, new_folder
from .words import cuts as slices
from .words import expand, give_back, process_cache, split_words

#: Ids in one segment, about, and units (see ``WordEncoder``) whose ids a worker remembers, with the bytes of their text.
SEGMENT_IDS, REMEMBERED, REMEMBERED_BYTES = 4_000_000, 500_000, 64 << 20
#: Segments in one file: a file is read back as one value, which must stay far below 2 GB.
FILE_SEGMENTS = 16
#: What a tokenizer must code alike as a whole and word by word.
_PROBE = "It's the 1st  Test,\twith\ncaf\u00e9 \u6f22\u5b57 <|endoftext|> #tags... don't x.y/z A\u00a0b \U0001f600 we'll 12,5"


class WordEncoder:
    """Encodes word by word: the vocabularies used here never join text across white space.

    A word of letters, with marks behind them or not, is two units, as no token joins
    letters and marks either; of all other words each is one unit.  Every unit is
    encoded once and remembered, in lower case where the tokenizer ignores case.
    Units of letters or of marks are encoded many in one string: each closes with one
    token that ends a word, by which they are found again.  All others are encoded alone.
    """

    #: Letters that normalising keeps letters, one to one, and marks that open neither a contraction nor a special token.
    _LETTERS = "".join(chr(i) for i in range(0x41, 0x100) if chr(i).isalpha() and chr(i) not in "\u00aa\u00b5\u00ba")
    _MARKS = "].,;:!?#$%&*()\"+=/\\@^_`~{}[-"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        alone = [i for e in self.tokenizer.encode_batch(_PROBE.split(), add_special_tokens=False) for i in e.ids]
        if alone != self.tokenizer.encode(_PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path} does not code text word by word")
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.ignores_case = self._ignores_case()
        self.known, self.flat, self.lengths = pa.array([""]), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ignores_case(self) -> bool:
        normal, added = self.tokenizer.normalizer, self.tokenizer.get_added_tokens_decoder().values()
        alike = normal is not None and normal.normalize_str(self._LETTERS) == normal.normalize_str(self._LETTERS.lower())
        return alike and all(x.content.startswith("<") for x in added)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        cache, key = process_cache(), ("word-encoder", path)
        if key not in cache:
            cache[key] = cls(path)
        return cache[key]

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(units) else self._alone(units)

    def _fresh(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units' places in ``units`` in the order coded, their ids in a row, and how many each has."""
        letters, marks = (pc.equal(pc.utf8_trim(units, characters=x), "") for x in (self._LETTERS, self._MARKS))
        simple = pc.or_(letters, marks).to_numpy(zero_copy_only=False)
        order, texts, parts = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)]), units.to_numpy(zero_copy_only=False), []
        n = int(simple.sum())
        for i in range(0, n, 1000):
            parts.append(self._together(texts[order[i : min(i + 1000, n)]].tolist()))
        if n < len(order):
            parts.append(self._alone(texts[order[n:]].tolist()))
        return order, *(np.concatenate(x) for x in zip(*parts))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        heads = pc.ascii_rtrim(words, characters=self._MARKS)
        plain = pc.equal(pc.utf8_trim(heads, characters=self._LETTERS), "")
        tails = pc.if_else(plain, pc.utf8_ltrim(words, characters=self._LETTERS), "")
        heads = pc.if_else(plain, pc.utf8_lower(heads) if self.ignores_case else heads, words)
        units = pa.concat_arrays([heads, tails]).dictionary_encode()
        rows = pc.fill_null(pc.index_in(units.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        flat, lengths, new = self.flat, self.lengths, np.flatnonzero(rows < 0)
        if len(new):
            order, ids, counts = self._fresh(units.dictionary.take(pa.array(new)))
            new = new[order]
            rows[new] = len(lengths) + np.arange(len(new))
            flat, lengths = np.concatenate([flat, ids]), np.concatenate([lengths, counts])
            known = pa.concat_arrays([self.known, units.dictionary.take(pa.array(new))])
            if len(self.known) < REMEMBERED and known.nbytes <= REMEMBERED_BYTES:
                self.known, self.flat, self.lengths = known, flat, lengths
        pairs = rows[units.indices.to_numpy()].reshape(2, -1).T.ravel()
        return flat[expand(pairs, lengths, np.cumsum(lengths) - lengths)], lengths[pairs].reshape(-1, 2).sum(axis=1)

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by ``end``, and how many each has."""
        offsets, codes, vocabulary = split_words(texts)
        flat, lengths = self.words(vocabulary)
        codes = np.insert(codes, offsets[1:], len(lengths))  # the end is one more word
        flat, lengths = np.append(flat, np.uint32(end)), np.append(lengths, 1)
        starts, parts = np.cumsum(lengths) - lengths, np.array_split(codes, len(codes) // 500_000 + 1)
        ids = np.concatenate([flat[expand(x, lengths, starts)] for x in parts])
        until = np.cumsum(lengths[codes])[offsets[1:] + np.arange(len(texts))]
        return ids, np.diff(until, prepend=0)


def _encoder(path: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size = WordEncoder.of(path), [], 0

        def segment() -> pa.RecordBatch:
            data = encode_segment(*[np.concatenate(x) for x in zip(*held)])
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["segment"])

        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):  # the more text, the fewer words come twice
                ids, counts = coder.texts(batch["text"], end)
                column = batch["doc_id"]
                held.append((column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False), counts, ids))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield segment()
                    held, size = [], 0
        if held:
            yield segment()
        held = []
        give_back()  # once a task: between slices the system would take and clear the same pages again

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 1, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the ids of all rows as files of segments (see ``blockfile``) under ``path``.

    Rows are range-partitioned and sorted by id (nulls first, then by text), so
    files in name order hold ascending ids.  A task holds one segment at a time, a
    file at most ``FILE_SEGMENTS``; a larger task writes several files.  Spark's own
    writer puts the files in place, so ``path`` may be in any store and lost tasks
    run again.  The tokenizer must code word by word, which a probe text checks.

    Null text: an empty one, which has the end id alone.  Null ids come first,
    repeated rows are rows like any other.  Empty table: no documents.  Other
    columns, of whatever name, are not read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    segments = ordered.mapInArrow(_encoder(tokenizer, end), "segment binary")
    segments.select(F.col("segment").cast("string")).write.mode("append").option("compression", "none").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            for doc_ids, has_id, counts, ids in decode_segments(content.as_py()):
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(counts.astype(np.int64)) * 4
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends - counts.astype(np.int64) * 4, ends)]
                columns = [pa.array(doc_ids, mask=~has_id), pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            for doc_ids, has_id, counts, ids in decode_segments(content.as_py()):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=~has_id), lists], names=["doc_id", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids`` of every document in the files under ``path``; ids of documents may be null or repeat as written."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unpack, "doc_id long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files under ``path``; no files, no rows."""
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, "doc_id long, n_tokens long, ids_crc32 long")
    placed = with_prefix(cut(rows, "token-rows"), "doc_id", ["n_tokens"], ["n_tokens", "ids_crc32"])
    return placed.select("doc_id", F.col("before_n_tokens").alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write ``docs`` to new files in the session's shared folder and read them back.

    ``start`` counts the ids of all rows before a row in id order; rows of one id
    stand by count and checksum.  A null id stands before all others.  Null or empty
    text: the end id alone.  Empty table: no rows.  Other columns are not read.
    """
    path = new_folder(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end)
    return read_digests(docs.sparkSession, path)
