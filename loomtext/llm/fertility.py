"""Quality rules: plain text rules and tokeniser fertility bands per language."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import grams, mix, process_cache, slices, split_words, vocabulary_hashes

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


class Band(NamedTuple):
    """What a text's tokens must keep within.

    ``least`` and ``most`` characters per byte-level token, ``fallback`` the most
    single bytes among the pieces, ``entropy`` the least bits per run of
    ``RUN`` pieces, and for a language the scripts it is written in.
    """

    least: float
    most: float
    fallback: float
    entropy: float
    scripts: tuple[str, ...] = ()


#: Bands by language.  en, fr, de, es: set beside the labelled rows of sf0.1, where rows of
#: quality 1 have at least 2.33, 2.12, 2.52 and 2.30 characters per token, at most 0.04
#: fallback and at least 4.87 bits; shouting, symbol runs and lists lie below.  The tables' words are
#: invented: real English has about 5 characters per token, so the upper ends are wide.
#: The others: set beside one paragraph each (tests/llm/prose.py), between its figures and
#: those of the same number of random letters of the script.
LANGUAGES = {
    "en": Band(2.1, 8.0, 0.15, 4.75, ("Latin",)), "fr": Band(1.95, 7.5, 0.15, 4.75, ("Latin",)),
    "de": Band(2.2, 7.5, 0.15, 4.75, ("Latin",)), "es": Band(2.05, 7.5, 0.15, 4.75, ("Latin",)),
    "ru": Band(1.8, 6.0, 0.15, 4.6, ("Cyrillic",)), "uk": Band(1.6, 6.0, 0.15, 4.6, ("Cyrillic",)),
    "ar": Band(1.5, 5.0, 0.15, 3.4, ("Arabic",)), "he": Band(1.45, 5.0, 0.15, 3.2, ("Hebrew",)), "el": Band(1.45, 5.0, 0.08, 3.4, ("Greek",)),
    "hi": Band(0.65, 3.0, 0.4, 3.4, ("Devanagari",)), "zh": Band(0.55, 3.0, 0.7, 3.5, ("Han",)),
    "ja": Band(0.93, 3.0, 0.5, 3.8, ("Kana", "Han")), "ko": Band(0.65, 4.0, 0.7, 3.8, ("Hangul",)),
}
#: Of any other or no language, and where the text is not in its language's scripts: bands by
#: the script of most letters.  Latin's also holds for texts without letters.  Scripts
#: without an entry meet the base rules only: the vocabularies do not cover them.
SCRIPTS = {
    "Latin": Band(1.72, 8.0, 0.25, 4.5), "Cyrillic": Band(1.3, 6.0, 0.25, 4.4), "Greek": Band(1.0, 5.0, 0.25, 3.3), "Hebrew": Band(1.35, 5.0, 0.25, 3.2),
    "Arabic": Band(1.1, 5.0, 0.25, 3.0), "Devanagari": Band(0.6, 3.0, 0.4, 3.3), "Hangul": Band(0.6, 4.0, 0.75, 3.8), "Kana": Band(0.93, 3.0, 0.5, 3.8),
    "Han": Band(0.55, 3.0, 0.7, 3.5),
}
#: Pieces in one run of the entropy, and code points above which a text is coded in parts.
RUN, PART = 64, 50_000
#: Ranges of code points of the scripts' letters; ``Other`` is every letter above them.
_SCRIPTS = (
    ("Latin", "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"), ("Greek", "\u0370-\u03ff\u1f00-\u1fff"),
    ("Cyrillic", "\u0400-\u052f"), ("Hebrew", "\u05d0-\u05ea"), ("Arabic", "\u0620-\u06ff\u0750-\u077f"), ("Devanagari", "\u0900-\u097f"),
    ("Hangul", "\u1100-\u11ff\u3130-\u318f\uac00-\ud7af"), ("Kana", "\u3041-\u30ff"), ("Han", "\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003134f"),
    ("Other", "\u0530-\u058f\u0700-\u074f\u0780-\u08ff\u0980-\u10ff\u1200-\u1dff\u2c00-\u2dff\ua000-\uabff\U00010000-\U0001efff"),
)
_NOT_OF = {name: re.compile(f"[^{letters}]+") for name, letters in _SCRIPTS}
MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_chars n_pieces n_tokens n_fallback".split()
COLUMNS = ", ".join([*[f"{m} long" for m in MEASURES], "entropy double", "script string"])


def _vocabularies(pieces: str, ranks: str, pattern: str) -> tuple:
    cache, key = process_cache(), ("fertility", pieces, ranks, pattern)
    if key not in cache:
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        cache[key] = (
            model,
            tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}),
            np.array([model.is_byte(i) for i in range(model.get_piece_size())]),
        )
    return cache[key]


def parts(text: str, limit: int = PART) -> list[str]:
    """A long text cut before single spaces between words, where tokens begin anyway.

    Where none of ``limit`` code points is such a place, the cut falls after them;
    the byte-level coder cannot take runs of a million blanks at once.
    """
    out, at = [], 0
    while len(text) - at > limit:
        end = text.rfind(" ", at + 1, at + limit)
        while end > at and (text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.rfind(" ", at + 1, end)
        end = end if end > at else at + limit
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def repeated_words(hashes: np.ndarray, offsets: np.ndarray, k: int = 3) -> np.ndarray:
    """Words of each text that stand in a ``k``-word window found twice or more in that text."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = grams(hashes, k)
    inside = doc[: len(windows)] == doc[k - 1 :] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    keys = windows[at] ^ mix(mix(doc[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for j in range(k):
        covered[at[twice] + j] = True
    return np.bincount(doc[covered], minlength=len(offsets) - 1)


def entropies(codes: np.ndarray, offsets: np.ndarray, run: int = RUN) -> np.ndarray:
    """Mean entropy in bits of each owner's runs of ``run`` codes; the rest of a run joins the run before it.

    Owner ``i`` has ``codes[offsets[i]:offsets[i + 1]]``.  Entropy grows with the
    number of codes, so runs of one length make long and short texts comparable; a
    run of another length is scaled by the entropy of as many different codes.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    runs = np.maximum(sizes // run, (sizes > 0).astype(np.int64))
    first = np.cumsum(runs) - runs
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], sizes)
    mine = np.repeat(first, sizes) + np.minimum(place // run, np.repeat(np.maximum(runs, 1), sizes) - 1)
    width = int(codes.max(initial=0)) + 1
    keys = np.sort(mine * width + codes)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(head, len(keys))).astype(np.float64)
    totals = np.bincount(mine, minlength=int(runs.sum())).astype(np.float64)
    bits = np.log2(totals) - np.bincount(keys[head] // width, counts * np.log2(counts), len(totals)) / totals
    bits = bits * np.where(totals > 1, np.log2(run) / np.log2(np.maximum(totals, 2)), 0.0)
    owner = np.repeat(np.arange(n), runs)
    return np.bincount(owner, bits * totals, n) / np.maximum(sizes, 1)


def dominant_script(text: str) -> str:
    """The script of most of the text's letters; Japanese is that of its kana; empty without letters."""
    if text.isascii():
        return "Latin" if any(c.isalpha() for c in text) else ""
    counts = {name: len(pattern.sub("", text)) for name, pattern in _NOT_OF.items()}
    if 4 * counts["Kana"] > counts["Han"]:
        counts["Kana"] += counts.pop("Han")
    best = max(counts, key=counts.get)
    return best if counts[best] else ""


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _measurer(pieces: str, ranks: str, pattern: str, text: str, with_text: bool):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, encoding, single = _vocabularies(pieces, ranks, pattern)
        for whole in batches:
            for batch in slices(whole, text):
                texts = [x or "" for x in batch[text].to_pylist()]
                coded = [model.encode(t, num_threads=1) for t in texts]
                n_pieces = np.fromiter(map(len, coded), np.int64, len(coded))
                flat = np.fromiter(chain.from_iterable(coded), np.int64, int(n_pieces.sum()))
                del coded
                bounds = np.concatenate([[0], np.cumsum(n_pieces)])
                offsets, codes, vocabulary = split_words(batch[text])
                columns = [
                    np.diff(offsets),
                    np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64),
                    np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
                    np.array([_repeated_lines(t) for t in texts], np.int64),
                    repeated_words(vocabulary_hashes(vocabulary)[codes], offsets),
                    np.array([len(t) for t in texts], np.int64),
                    n_pieces,
                    np.array([sum(len(encoding.encode_ordinary(p)) for p in parts(t)) for t in texts], np.int64),
                    np.diff(np.concatenate([[0], np.cumsum(single[flat])])[bounds]),
                ]
                measured = [pa.array(c.astype(np.int64)) for c in columns] + [pa.array(entropies(flat, bounds))]
                measured.append(pa.array([dominant_script(t) for t in texts], pa.string()))
                names = [x.split()[0] for x in COLUMNS.split(", ")]
                kept = [i for i, f in enumerate(batch.schema) if with_text or f.name != text]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + measured, names=[batch.schema.field(i).name for i in kept] + names)

    return measure


def _verdict(lang: Column, languages: dict[str, Band], scripts: dict[str, Band]) -> tuple[Column, Column, Column, Column]:
    per_token = F.col("n_chars") / F.greatest(F.col("n_tokens"), F.lit(1))
    fallback = F.col("n_fallback") / F.greatest(F.col("n_pieces"), F.lit(1))
    script = F.col("script")

    def within(band: Band) -> Column:
        return per_token.between(band.least, band.most) & (fallback <= band.fallback) & (F.col("entropy") >= band.entropy)

    good = F.when(F.lit(False), F.lit(True))
    for name, band in languages.items():
        good = good.when((lang == name) & script.isin(*band.scripts), within(band))
    for name, band in scripts.items():
        good = good.when(script.isin(name, "") if name == "Latin" else script == name, within(band))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return failed, ~failed & good.otherwise(F.lit(True)), per_token, fallback


def quality(
    docs: DataFrame, pieces: str, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    languages: dict[str, Band] | None = None, scripts: dict[str, Band] | None = None,
) -> DataFrame:
    """Measures and verdict of every row.

    ``pieces`` is a SentencePiece model with byte fallback, ``ranks`` a byte-level
    vocabulary with its split ``pattern``; both code whole texts.  Measures: words
    and the characters in them, symbols, lines with a word that repeat an earlier
    line, words in repeated three-word windows; characters per byte-level token,
    the share of byte-fallback pieces and the pieces' entropy (per run of ``RUN``).

    ``base_failed``: fewer than 50 words, or more than half of them repeated.
    ``kept``: not failed, and all three token measures within the ``Band`` of the
    row's language (``LANGUAGES`` unless given) if the text's ``dominant_script``
    is one of that language's, else within that of the script (``SCRIPTS`` unless
    given); scripts without a band meet the base rules only.

    One pass, no shuffle.  Null or empty text: all measures 0, failed.  Null or
    unknown language, or no such column: judged by script.  Null ids, ties and
    repeated rows are rows like any other.  Empty table: no rows.  Other columns, of whatever name, are not read.
    """
    lang = F.col(lang_column) if lang_column in docs.columns else F.lit(None)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), lang.cast("string").alias("lang"), F.col(text_column).alias("text"))
    found = source.mapInArrow(_measurer(pieces, ranks, pattern, "text", False), "doc_id long, lang string, " + COLUMNS)
    failed, kept, per_token, fallback = _verdict(F.col("lang"), languages or LANGUAGES, scripts or SCRIPTS)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        kept.alias("kept"), per_token.alias("chars_per_token"), fallback.alias("fallback_share"), "entropy", "script",
    )


def passing(
    docs: DataFrame, pieces: str, ranks: str, pattern: str, text_column: str = "text", lang_column: str = "lang",
    languages: dict[str, Band] | None = None, scripts: dict[str, Band] | None = None,
) -> DataFrame:
    """The rows that ``quality`` keeps, with all their columns, of whatever name; texts are not shuffled.

    Null, empty and short texts fail.  Null ids and languages, ties and repeated
    rows are judged row by row.  Empty table: no rows.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = plain.columns[columns.index(text_column)]
    lang = F.col(plain.columns[columns.index(lang_column)]).cast("string") if lang_column in columns else F.lit(None).cast("string")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    found = plain.mapInArrow(_measurer(pieces, ranks, pattern, text, True), f"{out}, {COLUMNS}")
    return found.where(_verdict(lang, languages or LANGUAGES, scripts or SCRIPTS)[1]).select(*plain.columns).toDF(*columns)
