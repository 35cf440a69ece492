"""Words, hashes and batches, shared by the operators that work on Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Return freed memory to the system, which a worker would otherwise keep between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def cuts(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``max_bytes`` of text; a longer text stands alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, done + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``cuts``, after each of which memory is given back: for large ones, as that takes longer than the work on a small one."""
    for part in cuts(batch, column, max_bytes):
        yield part
        give_back()


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: ``(offsets, codes, vocabulary)``.

    Text ``i`` has the words ``codes[offsets[i]:offsets[i + 1]]``, numbers into the
    vocabulary.  Null: no words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    parts, bounds = lists.values, lists.offsets.to_numpy()
    full = pc.binary_length(parts).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    coded = parts.filter(pa.array(full)).dictionary_encode()
    return before[bounds], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def vocabulary_hashes(vocabulary: pa.Array) -> np.ndarray:
    words = vocabulary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out[i] = out[i - 1] * _MULTIPLIER
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive entries (polynomial, then mixed)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(k)):
        out += hashes[j : j + n] * p
    return mix(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def process_cache() -> dict:
    """A dict that lives as long as this Python process, for models that tasks load once."""
    return sys.__dict__.setdefault("_loomtext_cache", {})


def expand(codes: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of the entries ``starts[c] .. starts[c] + lengths[c]`` for each code in turn."""
    sizes = lengths[codes]
    ends = np.cumsum(sizes)
    shift = np.repeat(starts[codes] - (ends - sizes), sizes)
    return shift + np.arange(len(shift))
