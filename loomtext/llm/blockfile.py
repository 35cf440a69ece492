"""Token-id files in patched frame-of-reference blocks.

A file is a sequence of segments, each followed by one newline.  A segment holds
whole documents in order (all integers little-endian):

====================  =====================================================
magic                 ``PFR1``
n_docs, n_ids         u64, u64
n_blocks, n_patches   u64, u64
payload               u64, bytes of the packed area
doc ids               i64 each; then one byte each: 1 if there is an id
ids per document      u32 each
block minimum         u32 each
block width           u8 each, bits of a packed value
patches per block     u8 each
block start           u64 each, byte offset into the packed area
packed area           per block: ``BLOCK`` values at the block's width
patch places          u8 each, by block
patch values          u32 each, value less the minimum
====================  =====================================================

A block's width is that of its ``PERCENTILE``-th value above the minimum; values
that do not fit are patches.  The last block is padded with its minimum.  The
index of starts, together with the prefix of patch counts, gives any block without
unpacking those before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC, BLOCK, PERCENTILE = b"PFR1", 128, 90
_HEAD = "<4s5Q"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits needed by each value (0 for 0), below 2**32."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values as rows of bytes, ``width`` bits a value, lowest bits first."""
    columns, out = values.T.astype(np.uint64, order="C"), np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    for i, column in enumerate(columns):
        word, shift = divmod(i * width, 64)
        out[word] |= column << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= column >> np.uint64(64 - shift)
    return out.T.astype("<u8", order="C").view(np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """What ``_pack`` was given."""
    words, out = packed.view("<u8").T.astype(np.uint64, order="C"), np.empty((BLOCK, len(packed)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        out[i] = value & mask
    return out.T


def encode_segment(doc_ids: np.ndarray, has_id: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    n_blocks = -(-len(ids) // BLOCK)
    full = np.zeros(n_blocks * BLOCK, np.uint32)
    full[: len(ids)] = ids
    blocks = full.reshape(n_blocks, BLOCK)
    if len(ids) % BLOCK:
        last = blocks[-1, : len(ids) % BLOCK]
        blocks[-1, len(ids) % BLOCK :] = last.min()
    least = blocks.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    above = blocks - least[:, None]
    rank = BLOCK * PERCENTILE // 100 - 1
    width = _bits(np.partition(above, rank, axis=1)[:, rank]) if n_blocks else np.zeros(0, np.uint8)
    large = above > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    patch_counts = large.sum(axis=1).astype(np.uint8)
    places = np.nonzero(large)[1].astype(np.uint8)
    patches = above[large].astype(np.uint32)
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), np.uint8)
    above[large] = 0
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            for some in np.array_split(which, max(1, len(which) // 4096)):
                packed = _pack(above[some], int(w))
                payload[starts[some][:, None] + np.arange(packed.shape[1])] = packed
    head = struct.pack(_HEAD, MAGIC, len(doc_ids), len(ids), n_blocks, len(patches), len(payload))
    parts = [
        doc_ids.astype("<i8"), has_id.astype(np.uint8), counts.astype("<u4"), least.astype("<u4"), width, patch_counts,
        starts.astype("<u8"), payload, places, patches.astype("<u4"),
    ]
    return head + b"".join(x.tobytes() for x in parts)


def decode_segments(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``doc_ids, has_id, counts, ids`` of each segment of a file."""
    at = 0
    while at < len(data):
        magic, n_docs, n_ids, n_blocks, n_patches, size = struct.unpack_from(_HEAD, data, at)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        at += struct.calcsize(_HEAD)
        columns = []
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_blocks), ("u1", n_blocks), ("u1", n_blocks), ("<u8", n_blocks), ("u1", size), ("u1", n_patches), ("<u4", n_patches)):
            columns.append(np.frombuffer(data, kind, n, at))
            at += columns[-1].nbytes
        doc_ids, has_id, counts, least, width, patch_counts, starts, payload, places, patches = columns
        values = np.zeros((n_blocks, BLOCK), np.uint32)
        for w in np.unique(width):
            if w:
                which = np.flatnonzero(width == w)
                for some in np.array_split(which, max(1, len(which) // 4096)):
                    packed = payload[starts[some].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
                    values[some] = _unpack(packed, int(w))
        values[np.repeat(np.arange(n_blocks), patch_counts), places] = patches
        yield doc_ids, has_id.astype(bool), counts, (values + least[:, None]).reshape(-1)[:n_ids]
        at += 1  # the newline
