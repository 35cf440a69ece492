"""Substring dedup: documents are parsed greedily into factors of indexed blocks of earlier text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, release
from .words import grams, mix, signed, slices, split_words, vocabulary_hashes

#: Words of a window, and of the anchors by which reference blocks are indexed.
WINDOW, ANCHOR = 20, 6
#: Contents of an anchor in a batch from which on it is dealt over lanes, and their number.
MANY, LANES = 8, 256
#: Documents in one row's list of later ones; more take several rows.
LISTED = 256
#: What a row is: a sign that its anchor is dealt over lanes (sorted first); to be judged; one of such an anchor.
MARKER, OPEN, EDGE = range(3)
#: A block or window, the first place that has it in its batch, and the batch's later documents with it.
ROWS = "route long, content long, doc_id long, at int, role int, later array<long>"
#: What the index answers: late ones with their place in the reference, others as boundary
#: blocks; ``late`` null: rows of an anchor that is dealt over lanes, to be judged there.
FOUND = "doc_id long, content long, late boolean, source_id long, source_at int, route long, later array<long>"


class Parse:
    """Windows and blocks of a batch of texts.

    A window's anchor is the least hash of its ``ANCHOR``-word runs.  A block is a
    longest run of neighbouring windows with one anchor; equal windows have equal
    anchors wherever they stand, so a window can only recur in a block of the
    same anchor.
    """

    def __init__(self, texts: pa.Array):
        self.offsets, codes, vocabulary = split_words(texts)
        hashes = vocabulary_hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
        words = np.diff(self.offsets)
        counts = np.maximum(words - WINDOW + 1, 0)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])  # of each text's windows
        self.doc = np.repeat(np.arange(len(words)), counts)
        total = int(self.bounds[-1])
        #: Where each window starts, in words of the batch.
        self.start = np.arange(total) - np.repeat(self.bounds[:-1], counts) + np.repeat(self.offsets[:-1], counts)
        if not total:
            self.window = self.anchor = self.block = np.zeros(0, np.uint64)
            self.block_of = self.block_doc = self.block_first = self.place = np.zeros(0, np.int64)
            self.block_anchor = self.block
            return
        #: The same, in words of the window's own text.
        self.place = self.start - self.offsets[:-1][self.doc]
        self.window = grams(hashes, WINDOW)[self.start]
        anchor, width = grams(hashes, ANCHOR), 1
        span = WINDOW - ANCHOR + 1
        while 2 * width <= span:  # least of ever wider spans
            anchor, width = np.minimum(anchor[:-width], anchor[width:]), 2 * width
        anchor = np.minimum(anchor[: len(anchor) - (span - width)], anchor[span - width :]) if width < span else anchor
        self.anchor = anchor[self.start]
        new = np.ones(total, bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        self.block_of = np.cumsum(new) - 1
        self.block_doc = self.doc[first]
        self.block_first = first
        self.block_anchor = self.anchor[first]
        # a block's content is that of its windows in order
        place = np.arange(total) - first[self.block_of]
        self.block = mix(np.add.reduceat(mix(self.window + place.astype(np.uint64)), first) + np.diff(np.append(first, total)).astype(np.uint64))


def _gathered(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Of rows in id order: the first row of each key, and the other documents that have the key, ``LISTED`` at a time."""
    _, once, back = np.unique(key, return_index=True, return_inverse=True)
    _, keep = np.unique(key ^ mix(mix(ids.astype(np.uint64))), return_index=True)
    first, document = once[back[keep]], ids[keep]
    late = document > ids[first]
    owner, document = first[late], document[late]
    order = np.lexsort((document, owner))
    heads = np.sort(once)
    counts = np.bincount(np.searchsorted(heads, owner), minlength=len(heads))
    pieces = np.maximum(1, -(-counts // LISTED))
    number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    ends = np.repeat(np.cumsum(counts) - counts, pieces) + np.minimum((number + 1) * LISTED, np.repeat(counts, pieces))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(document[order], pa.int64()))
    return np.repeat(heads, pieces), lists


def _lane(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mix(anchor ^ mix(content % np.uint64(LANES) + np.uint64(1)))


def _rows(route: np.ndarray, content: np.ndarray, ids: np.ndarray, at: np.ndarray, role: np.ndarray, later: pa.Array) -> pa.RecordBatch:
    columns = [signed(route), signed(content), pa.array(ids, pa.int64()), pa.array(at.astype(np.int32)), pa.array(role.astype(np.int32)), later]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROWS.split(", ")])


def _blocks(many: int):
    """``ROWS`` of blocks; equal blocks of a batch are one row.

    Rows meet by their anchor.  An anchor of at least ``many`` contents in a batch is
    dealt over lanes by content, as it is known to have company; a MARKER tells this to
    the rows of other batches that come by the anchor alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole.filter(pc.is_valid(whole["doc_id"])), "text"):
                batch = batch.take(pc.sort_indices(batch["doc_id"]))
                p = Parse(batch["text"])
                every = batch["doc_id"].to_numpy()[p.block_doc]
                rows, later = _gathered(p.block ^ mix(p.block_anchor), every)
                anchor, content = p.block_anchor[rows], p.block[rows]
                single = np.unique(rows, return_index=True)[1]
                names, counts = np.unique(anchor[single], return_counts=True)
                names = names[counts >= many]
                edge = np.isin(anchor, names)
                route = np.where(edge, _lane(anchor, content), anchor)
                yield _rows(route, content, every[rows], p.place[p.block_first][rows], np.where(edge, EDGE, OPEN), later)
                if len(names):
                    none = np.zeros(len(names), np.int64)
                    yield _rows(names, none.astype(np.uint64), none, none, none + MARKER, pa.array([[]] * len(names), pa.list_(pa.int64())))

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream ``ROWS`` sorted by route, role, content, doc_id, at into ``FOUND``.

    ``late``: the content occurs in an earlier document, and its first place is the
    source.  Not late: it is the first of its content, and its anchor has other contents
    too.  Rows of an anchor with a MARKER are passed on to their lane.
    """
    anchor = content = None  # of the row before; a route stands for its anchor
    many = False  # the anchor of the row before has a MARKER
    least = least_at = 0  # document and place of the first row of its content
    waiting: list[int] = []  # the documents of the anchor's only content so far
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, c, d, at, role = (batch[x].to_numpy() for x in ("route", "content", "doc_id", "at", "role"))
        same_a = np.concatenate([[a[0] == anchor], a[1:] == a[:-1]])
        same_c = same_a & np.concatenate([[c[0] == content], c[1:] == c[:-1]])
        group = np.cumsum(~same_c)
        head = np.flatnonzero(~same_c)
        lows, lows_at = np.append(least, d[head])[group], np.append(least_at, at[head])[group]
        late = d > lows
        # an anchor with several contents: some row of it starts a content but not the anchor
        anchors = np.cumsum(~same_a)
        several = np.zeros(anchors[-1] + 1, bool)
        several[anchors[same_a & ~same_c]] = True
        dealt = np.zeros(anchors[-1] + 1, bool)
        dealt[0] = many
        dealt[anchors[role == MARKER]] = True
        if several[0] and waiting:  # the carried content has got company
            m = len(waiting)
            yield _verdict(np.full(m, content), np.array(waiting), np.zeros(m, bool), np.zeros(m, np.int64), np.zeros(m, np.int32))
            waiting = []
        if anchors[-1] != 0:
            waiting = []
        elif not waiting and anchor is not None and same_a[0]:
            several[0] = True  # company came in an earlier batch
        owner, documents = _owned(batch["later"])
        live = ~dealt[anchors]
        out = live & (late | several[anchors] | (role == EDGE))
        yield _verdict(c[out], d[out], late[out], lows[out], lows_at[out])
        use = live[owner]
        owner, documents = owner[use], documents.to_numpy(zero_copy_only=False)[use]
        yield _verdict(c[owner], documents, np.ones(len(owner), bool), lows[owner], lows_at[owner])
        again = ~live & (role == OPEN)
        if again.any():
            lanes = _lane(a[again].view(np.uint64), c[again].view(np.uint64)).view(np.int64)
            yield _verdict(c[again], d[again], None, d[again], at[again], lanes, batch["later"].filter(pa.array(again)))
        if not several[anchors[-1]] and not dealt[-1]:
            waiting = waiting + d[(anchors == anchors[-1]) & ~late & (role == OPEN)].tolist()
        anchor, content, many, least, least_at = a[-1], c[-1], dealt[-1], lows[-1], lows_at[-1]


def _verdict(
    content: np.ndarray, ids: np.ndarray, late: np.ndarray | None, source_ids: np.ndarray, source_at: np.ndarray, route: np.ndarray | None = None, later: pa.Array | None = None
) -> pa.RecordBatch:
    n = len(ids)
    columns = [
        pa.array(ids, pa.int64()), pa.array(content, pa.int64()), pa.nulls(n, pa.bool_()) if late is None else pa.array(late),
        pa.array(source_ids, pa.int64()), pa.array(source_at.astype(np.int32)),
        pa.nulls(n, pa.int64()) if route is None else pa.array(route), pa.nulls(n, pa.list_(pa.int64())) if later is None else later,
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])


def _keys(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(value) ^ mix(mix(owner.astype(np.uint64)))


def _owned(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Owner of each entry of an array column, and the entries."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()


def _places(owner: np.ndarray, value: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which (owner, value) pairs stand in the lists of ``content, source_id, source_at``, and their sources."""
    o, found = _owned(lists)
    content, source, at = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    keys = _keys(o, content.view(np.uint64))
    order = np.argsort(keys)
    asked = _keys(owner, value)
    near = np.minimum(np.searchsorted(keys[order], asked), max(len(keys) - 1, 0))
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    row = order[near]
    return keys[row] == asked, source[row], at[row].astype(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ROWS`` of the windows of blocks that have company at their anchor; equal windows meet, and nothing else."""
    for whole in batches:
        for batch in slices(whole, "text"):
            batch = batch.take(pc.sort_indices(batch["doc_id"]))
            p = Parse(batch["text"])
            owner, edges = _owned(batch["edges"])
            asked = np.isin(_keys(p.block_doc, p.block), _keys(owner, edges.to_numpy(zero_copy_only=False).view(np.uint64)))
            use = asked[p.block_of] if len(p.block) else np.zeros(0, bool)
            every, anchor, content = batch["doc_id"].to_numpy()[p.doc[use]], p.anchor[use], p.window[use]
            rows, later = _gathered(content ^ mix(anchor), every)
            route = mix(anchor[rows] ^ mix(content[rows]))
            yield _rows(route, content[rows], every[rows], p.place[use][rows], np.full(len(rows), OPEN), later)


def _runs(diagonal: np.ndarray, source: np.ndarray, known: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window, how many from it on lie one after the other in one source."""
    n = len(known)
    follows = known[1:] & known[:-1] & (diagonal[1:] == diagonal[:-1]) & (source[1:] == source[:-1]) & (doc[1:] == doc[:-1])
    ends = np.append(np.flatnonzero(~follows), n - 1)
    return np.where(known, ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1, 0)


def _levels(windows: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ... the least place at which the ``2**k`` windows from each place on stand; the last k of which any recur."""
    levels, key = [], windows
    while True:
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(first) == len(key):
            return levels
        levels.append(first[back].astype(np.int32))
        width = 1 << (len(levels) - 1)
        if len(key) <= width:
            return levels
        key = levels[-1][:-width].astype(np.int64) * len(windows) + levels[-1][width:]


def _longest(levels: list[np.ndarray], i: int, beyond: int) -> tuple[int, int]:
    """Longest run of windows from ``i`` on that starts earlier in the same text too, and the least such place.

    Runs known to be no longer than ``beyond`` are not looked for.
    """
    top = next((k for k in reversed(range(len(levels))) if i < len(levels[k]) and levels[k][i] < i), -1)
    if 2 << max(top, 0) <= beyond or top < 0:
        return 0, 0
    places, length = np.flatnonzero(levels[top][:i] == levels[top][i]), 1 << top
    for k in reversed(range(top)):
        if i + length < len(levels[k]):
            further = places[levels[k][places + length] == levels[k][i + length]]
            if len(further):
                places, length = further, length + (1 << k)
    return length, int(places[0])


def _factors(p: Parse, ids: np.ndarray, blocks: pa.Array, windows: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """``text, start, words, source_id, source_start`` of the factors of each text, from left to right.

    A window's place in other texts is that of its block or, at a boundary, its own; its
    places in its own text are all that start earlier.  At the first window that has
    one the longest run is taken, and the parse goes on behind it.
    """
    total = len(p.window)
    if not total:
        return
    known, source, at = (x[p.block_of] for x in _places(p.block_doc, p.block, blocks))
    at = at + np.arange(total) - p.block_first[p.block_of]
    single, own_source, own_at = _places(p.doc, p.window, windows)
    source, at = np.where(known, source, own_source), np.where(known, at, own_at)
    known = known | single
    _, once, back = np.unique(_keys(p.doc, p.window), return_index=True, return_inverse=True)
    again = once[back] < np.arange(total)
    outside = _runs(at - p.place, source, known, p.doc)
    hits = np.flatnonzero(known | again)
    i, text, levels = 0, -1, []
    while i < len(hits):
        w = hits[i]
        length, place, inside = int(outside[w]), int(p.place[w]), 0
        if again[w]:
            if text != p.doc[w]:
                text = p.doc[w]
                levels = _levels(p.window[p.bounds[text] : p.bounds[text + 1]])
            inside, earlier = _longest(levels, place, length)
        other = length >= inside
        length = max(length, inside)
        yield int(p.doc[w]), place, length + WINDOW - 1, int(source[w] if other else ids[p.doc[w]]), int(at[w] if other else earlier)
        i = int(np.searchsorted(hits, w + length))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The factors of each text, and the words they cover as spans ``[start, end)`` counted in words."""
    for whole in batches:
        for batch in slices(whole, "text"):
            p = Parse(batch["text"])
            ids = batch["doc_id"].fill_null(0).to_numpy()
            found = np.array(list(_factors(p, ids, batch["blocks"], batch["windows"])), np.int64).reshape(-1, 5)
            edge = np.zeros(int(p.offsets[-1]) + 1, np.int64)
            np.add.at(edge, p.offsets[found[:, 0]] + found[:, 1], 1)
            np.add.at(edge, p.offsets[found[:, 0]] + found[:, 1] + found[:, 2], -1)
            covered = np.cumsum(edge)[: int(p.offsets[-1])] > 0
            starts, ends, spans = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            texts = batch["text"].to_pylist()
            counts, removed, digests = [], [], []
            for i, text in enumerate(texts):
                a, b = p.offsets[i], p.offsets[i + 1]
                mask = covered[a:b]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                starts.append(turns[::2])
                ends.append(turns[1::2])
                spans.append(spans[-1] + len(turns) // 2)
                words = (text or "").encode().split()
                kept = compress(words, ~mask) if len(turns) else words
                counts.append(b - a)
                removed.append(int(mask.sum()))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends)], names=["start", "end"])
            bounds = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
            fields = [pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2].astype(np.int32)), pa.array(found[:, 3]), pa.array(found[:, 4].astype(np.int32))]
            parsed = pa.StructArray.from_arrays(fields, names=["start", "words", "source_id", "source_start"])
            columns = [
                batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests),
                pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pairs), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parsed),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors"])


def duplicate_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans, factors`` of every row.

    The reference of a document is all earlier text: documents of smaller ids, and
    what stands further up in the same one.

    1. Reference blocks: texts are cut into runs of windows with one anchor.  Blocks
       are indexed by anchor and content (128 bits), with the place (document, word)
       where a content first stands.  Of equal blocks in a batch only the first is
       shuffled, with the ids of the others.
    2. Boundaries: where an anchor has several contents, a factor may begin or end
       inside a block.  Only those boundary blocks are indexed window by window.
    3. Parse: each document is factored from left to right.  Of each block, or window of a
       boundary, one place in other texts is known, the first of all that met; within its
       own text every earlier place is.  A factor is the longest run of windows
       along these places, ties to the first place in other texts, then to the least in its own.
       It is not the longest over all places in other texts: of a passage that was put
       together anew from several, each part names the text that has it first.  Factors
       do not depend on the partitioning.
       ``factors`` holds ``start, words, source_id, source_start``, in words; each has
       at least ``WINDOW`` words, and the source holds the same ones.  Windows across
       the end of a factor count only if the reference holds them too, so
       neighbouring factors may overlap.
    4. ``spans``: the words that factors cover.  They are those of all windows that
       start earlier, whichever of several earlier places a factor names.

    Rows that meet are sorted and streamed, never held; an anchor of many contents, as
    at the edge of a passage that many documents quote, is dealt over lanes.  Null or
    empty text: no words.  Rows with a null id are only compared with themselves
    (their ``source_id`` is 0).  Rows of one id are no copies of each other.  Empty
    table: no rows.  Other columns, of whatever name, are not read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    blocks = cut(source.mapInArrow(_blocks(MANY), ROWS), "blocks")

    def judged(rows: DataFrame) -> DataFrame:
        keyed = rows.repartition("route").sortWithinPartitions("route", "role", "content", "doc_id", "at")
        return keyed.mapInArrow(_judge, FOUND)

    def listed(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("doc_id").agg(F.collect_list(F.struct("content", "source_id", "source_at")).alias(name))

    met = cut(judged(blocks.where(F.col("role") != EDGE)), "found")
    moved = met.where("late is null").select("route", "content", "doc_id", F.col("source_at").alias("at"), F.lit(EDGE).alias("role"), "later")
    lanes = cut(judged(blocks.where(F.col("role") == EDGE).unionByName(moved)), "lanes")
    release(blocks)
    found = met.where("late is not null").unionByName(lanes).select("doc_id", "content", "late", "source_id", "source_at")
    edges = found.where("not late").groupBy("doc_id").agg(F.collect_set("content").alias("edges"))
    inside = judged(source.join(edges, "doc_id").mapInArrow(_windows, ROWS)).where("late")
    verdicts = listed(found.where("late"), "blocks").join(listed(inside, "windows"), "doc_id", "full_outer")
    joined = source.join(verdicts, "doc_id", "left").select("doc_id", "text", "blocks", "windows")
    out = (
        "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, "
        "factors array<struct<start:int,words:int,source_id:long,source_start:int>>"
    )
    return joined.mapInArrow(_spans, out)
