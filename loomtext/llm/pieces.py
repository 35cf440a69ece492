"""SentencePiece encoding with sampled segmentations, and lossless decoding."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import expand, mix, process_cache, slices

#: A piece's log weight is -SLOPE * log(rank + SHIFT) (Zipf and Mandelbrot's law),
#: its rank being its place in the vocabulary's merge order.
SLOPE, SHIFT = 0.6, 10.0
#: Code points up to which units are filtered side by side; longer ones one by one.
LONG_UNIT = 64
#: The place holder for a space, and the mark that cuts a text into units.
SPACE, MARK = "▁", "\x00"
_BASE, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class Pieces:
    """The vocabulary as a hash table of code-point strings, and byte pieces for the rest."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * size
        words, ids = [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i)):
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} joins words, which units do not")
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                words.append(piece)
                ids.append(i)
        ranks = np.arange(1, len(ids) + 1)
        self.ids, self.weight = np.array(ids, np.int64), -alpha * SLOPE * np.log(ranks + SHIFT)
        self.byte_weight = -alpha * SLOPE * np.log(len(ids) + SHIFT)
        self.longest = max(map(len, words))
        hashes = self._hashes(words)
        bits = 1 << 20
        self.mask = np.uint64(bits - 1)
        self.slot = np.full(bits, -1, np.int32)
        order = np.argsort(hashes & self.mask, kind="stable")
        self.hashes, self.row = hashes[order], order.astype(np.int32)
        places = (self.hashes & self.mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        self.slot[places[first]] = first
        self.deepest = int(np.diff(np.append(first, len(places))).max())

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        """Rolling hashes over code points, as ``Lattices`` makes them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        starts, h = np.cumsum(sizes) - sizes, np.zeros(len(words), np.uint64)
        for i in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > i)
            h[on] = mix((h[on] ^ (points[starts[on] + i] + np.uint64(1))) * _BASE)
        return h

    @classmethod
    def of(cls, path: str, alpha: float = 1.0) -> Pieces:
        cache, key = process_cache(), ("pieces", path, SLOPE, SHIFT, alpha)
        if key not in cache:
            cache[key] = cls(path, alpha)
        return cache[key]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hashed string in the vocabulary, or -1."""
        at = self.slot[(hashes & self.mask).astype(np.int64)].astype(np.int64)
        found = np.full(len(hashes), -1, np.int64)
        open_ = np.flatnonzero(at >= 0)
        for _ in range(self.deepest):
            if not len(open_):
                break
            here = at[open_]
            hit = self.hashes[here] == hashes[open_]
            found[open_[hit]] = self.row[here[hit]]
            at[open_] += 1
            open_ = open_[~hit & (at[open_] < len(self.hashes))]
        return found


def cut_units(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``offsets, units``: each run of spaces opens a unit, each line end is one of its own; no piece crosses them."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        lists = pa.array([re.findall(r"\n| +[^ \n]*|[^ \n]+", t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        marked = pc.replace_substring_regex(pc.replace_substring(texts, "\n", MARK + "\n" + MARK), " +", MARK + r"\0")
        lists = pc.split_pattern(marked, MARK)
    sizes = pc.utf8_length(lists.values).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(sizes > 0)])
    return before[lists.offsets.to_numpy()], lists.values.filter(pa.array(sizes > 0))


class Lattices:
    """All segmentations of each distinct unit, with forward sums.

    Nodes are places in units; those before a unit's first code point come first.
    Short units are filtered together, depth by depth, ordered from the longest to
    the shortest, so that those that reach a depth are a prefix.  Long units, of any
    length, are filtered one by one.  Edges into a node stand together, those of
    the longest pieces first, with running sums of their share in the node's
    forward weight.
    """

    def __init__(self, model: Pieces, units: pa.Array):
        words = units.to_pylist()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        points[points == 0x2581] = 0x110000  # the place holder itself has no piece
        points[points == 0x20] = 0x2581
        starts = np.cumsum(sizes) - sizes
        short = np.flatnonzero(sizes <= LONG_UNIT)
        order = short[np.argsort(-sizes[short], kind="stable")]
        self.first = np.empty(len(words), np.int64)  # a unit's node before its first code point
        self.first[order] = np.arange(len(order))
        self.first[sizes > LONG_UNIT] = np.arange(len(order), len(words))
        self.roots = len(words)
        self.parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(self.roots, np.int32))]
        self.lone_points: list[np.ndarray] = []
        self.n_lone, n_nodes = 0, self.roots
        reach = np.searchsorted(-sizes[order], -np.arange(int(sizes[order].max(initial=0)) + 1), "right")  # units of each depth or more
        at_depth = np.concatenate([[0, self.roots], self.roots + np.cumsum(reach[1:])])
        self.last = np.empty(len(words), np.int64)  # a unit's last node
        self.last[order] = at_depth[sizes[order]] + np.arange(len(order))
        self._filter_short(model, points, starts[order], reach, at_depth)
        n_nodes = int(at_depth[-1])
        for i in np.flatnonzero(sizes > LONG_UNIT):
            self._filter_long(model, points[starts[i] : starts[i] + sizes[i]], int(self.first[i]), n_nodes)
            n_nodes += int(sizes[i])
            self.last[i] = n_nodes - 1
        columns = [list(x) for x in zip(*self.parts)]
        del self.parts
        self.tail, self.row, self.run, per_node = (np.concatenate(columns.pop(0)) for _ in range(4))
        ends = np.cumsum(per_node, dtype=np.int64)
        self.edges = ends - per_node
        self.run[ends[per_node > 0] - 1] = 1.0
        self.lone_point = np.concatenate([np.zeros(0, np.int64), *self.lone_points])

    def _add(self, tails: np.ndarray, rows: np.ndarray, run: np.ndarray, per_node: np.ndarray) -> None:
        """Edges of further nodes, in four bytes a number: nodes are fewer than twice the code points of a batch."""
        self.parts.append((tails.astype(np.int32), rows.astype(np.int32), run, per_node.astype(np.int32)))

    def _bare(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (below -1) and bytes of edges for code points without a piece."""
        real = np.where(point == 0x110000, 0x2581, np.where(point == 0x2581, 0x20, point)).astype(np.int64)
        rows = -2 - self.n_lone - np.arange(len(real))
        self.lone_points.append(real)
        self.n_lone += len(real)
        return rows, 1 + (real > 0x7F) + (real > 0x7FF) + (real > 0xFFFF)

    def _filter_short(self, model: Pieces, points: np.ndarray, starts: np.ndarray, reach: np.ndarray, at_depth: np.ndarray) -> None:
        forward, hashes = [np.zeros(len(starts))], []
        for depth in range(1, len(reach)):
            m = reach[depth]
            point = points[starts[:m] + depth - 1]
            hashes.append(np.zeros(m, np.uint64))
            froms = range(max(0, depth - model.longest), depth)
            found = np.empty((len(froms) + 1, m), np.int64)
            score = np.full((len(froms) + 1, m), -np.inf)
            for i, start in enumerate(froms):
                hashes[start] = mix((hashes[start][:m] ^ (point + np.uint64(1))) * _BASE)
                found[i] = model.find(hashes[start])
                hit = np.flatnonzero(found[i] >= 0)
                score[i, hit] = forward[start][hit] + model.weight[found[i, hit]]
            if depth > model.longest:
                hashes[depth - 1 - model.longest] = np.zeros(0, np.uint64)
            bare = np.flatnonzero(found[-2] < 0)
            found[-1] = -1
            found[-1, bare], width = self._bare(point[bare])
            score[-1, bare] = forward[depth - 1][bare] + model.byte_weight * width
            peak = score.max(axis=0)
            run = np.cumsum(np.exp(score - peak), axis=0)
            forward.append(peak + np.log(run[-1]))
            run /= run[-1]
            unit, edge = np.nonzero((found != -1).T)
            tails = at_depth[np.append(np.array(froms), depth - 1)[edge]] + unit
            self._add(tails, found[edge, unit], run[edge, unit], np.bincount(unit, minlength=m))

    def _filter_long(self, model: Pieces, points: np.ndarray, root: int, base: int) -> None:
        """One unit of any length: its edges are found place by place at once, then summed from left to right."""
        n = len(points)
        h, starts, sizes, rows, weights = np.zeros(n, np.uint64), [], [], [], []
        for size in range(1, min(model.longest, n) + 1):
            h = mix((h[: n - size + 1] ^ (points[size - 1 :] + np.uint64(1))) * _BASE)
            found = model.find(h)
            hit = np.flatnonzero(found >= 0)
            starts.append(hit)
            rows.append(found[hit])
            weights.append(model.weight[found[hit]])
            if size == 1:
                bare = np.flatnonzero(found < 0)
                lone, width = self._bare(points[bare])
                starts.append(bare)
                rows.append(lone)
                weights.append(model.byte_weight * width)
                sizes.append(np.zeros(len(hit), np.int64) + 1)
                sizes.append(np.zeros(len(bare), np.int64) + 1)
            else:
                sizes.append(np.zeros(len(hit), np.int64) + size)
        start, size, row, weight = (np.concatenate(x) for x in (starts, sizes, rows, weights))
        head = start + size
        order = np.lexsort((-size, head))
        start, head, row, weight = start[order], head[order], row[order], weight[order]
        counts = np.bincount(head, minlength=n + 1)[1:]
        tails, logs, forward, at = start.tolist(), weight.tolist(), [0.0], 0
        for edges in counts.tolist():  # scaled by each node's largest term, so that no weight is too small
            terms = [forward[tails[e]] + logs[e] for e in range(at, at + edges)]
            peak, at = max(terms), at + edges
            forward.append(peak + math.log(sum([math.exp(x - peak) for x in terms])))
        forward = np.array(forward)
        share = np.cumsum(np.exp(forward[start] + weight - forward[head]))
        ends = np.cumsum(counts)
        before = np.concatenate([[0.0], share])[ends - counts]
        run = share - np.repeat(before, counts)
        self._add(np.where(start == 0, root, base + start - 1), row, run, counts)

    def sample(self, codes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one segmentation of each unit in turn, in order, and how many each has."""
        at = self.last[codes]
        open_, steps = np.arange(len(codes)), []
        counts = np.zeros(len(codes), np.int64)
        while len(open_):
            u = (mix(keys[open_] + np.array([len(steps) + 1], np.uint64) * _SEED) >> np.uint64(12)).astype(np.float64) / float(1 << 52)
            edge = self.edges[at]
            on = np.flatnonzero(self.run[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[self.run[edge[on]] <= u[on]]
            steps.append((open_, edge))
            counts[open_] += 1
            at = self.tail[edge]
            more = at >= self.roots
            open_, at = open_[more], at[more]
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), np.int64)
        for i, (who, edge) in enumerate(steps):
            out[ends[who] - 1 - i] = edge
        return out, counts


def _ids_of_edges(model: Pieces, lattice: Lattices, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the edges in a row, and how many each edge has."""
    row = lattice.row[edges]
    lone = np.flatnonzero(row < 0)
    counts = np.ones(len(edges), np.int64)
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in lattice.lone_point[-2 - row[lone]]]
    counts[lone] = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.repeat(np.where(row >= 0, model.ids[np.maximum(row, 0)], 0), counts)
    if len(lone):
        starts = (np.cumsum(counts) - counts)[lone]
        out[expand(np.arange(len(lone)), counts[lone], starts)] = model.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
    return out, counts


def encode_batch(model: Pieces, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``offsets, ids`` of sampled segmentations; ``keys`` seeds each text."""
    offsets, units = cut_units(texts)
    if not len(units):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    coded = units.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    lattice = Lattices(model, coded.dictionary)
    sizes = np.diff(offsets)
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], sizes)
    edges, per_unit = lattice.sample(codes, mix(np.repeat(keys, sizes) ^ mix(place.astype(np.uint64))))
    ids, per_edge = _ids_of_edges(model, lattice, edges)
    edge_ends = np.concatenate([[0], np.cumsum(per_edge)])
    unit_ends = np.concatenate([[0], np.cumsum(per_unit)])
    return edge_ends[unit_ends[offsets]], ids


def _encoder(path: str, seed: int, alpha: float):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path, alpha)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                keys = mix(batch["doc_id"].fill_null(0).to_numpy().astype(np.uint64) + mix(np.array([seed], np.uint64)))
                offsets, ids = encode_batch(model, batch["text"], keys)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, batch["text"]], names=["doc_id", "ids", "text"])

    return encode


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces.of(path).bytes_of
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [b"".join(map(table.__getitem__, ids.as_py() or ())).decode("utf-8") for ids in part["ids"]]
                kept = [i for i, f in enumerate(part.schema) if f.name != "text"]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + [pa.array(texts, pa.string())], names=[part.schema.field(i).name for i in kept] + ["text"])

    return decode


def _checked(path: str, seed: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces.of(path, alpha).bytes_of
        for batch in _encoder(path, seed, alpha)(batches):
            values, offsets = batch["ids"].values.to_numpy(), batch["ids"].offsets.to_numpy()
            texts = batch["text"].to_pylist()
            same = [b"".join(map(table.__getitem__, values[a:b].tolist())) == (t or "").encode() for a, b, t in zip(offsets[:-1], offsets[1:], texts)]
            counts = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], counts, batch["ids"], pa.array(same)], names=["doc_id", "n_pieces", "ids", "lossless"])

    return run


def encode(docs: DataFrame, path: str, seed: int = 0, alpha: float = 1.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row: a segmentation drawn from all those of the text.

    A text is cut into units, each led by at most one run of spaces; no piece of the
    model crosses their bounds, so nothing is lost by it, and units are of any length.
    Over a unit's lattice of pieces forward sums are filtered once per distinct unit
    of a batch; every occurrence then samples backwards with numbers that depend on
    seed, id and its place alone, so the result is the same in any partitioning.  A
    segmentation's weight is the product of its pieces' to the power ``alpha``: 0 draws
    all alike, large values the heaviest.  Code points without a piece, and the
    space's place holder itself, become byte pieces.

    One pass, no shuffle.  Null or empty text: no ids.  Null id: drawn as id 0.  Rows
    of one id and text have equal ids.  Empty table: no rows.  Other columns, of
    whatever name, are not read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(_encoder(path, seed, alpha), "doc_id long, ids array<int>, text string").drop("text")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text``: the exact texts of ``doc_id, ids``.

    Null ids or none: an empty text.  Null document ids and repeated rows are rows like
    any other.  Empty table: no rows.  Other columns are not read.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, ids array<int>, text string").drop("ids")


def encode_checked(docs: DataFrame, path: str, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """``doc_id, n_pieces, ids, lossless``: ``encode``, with each text decoded and compared.

    A null text counts as an empty one, lossless with no ids.  Null ids, repeated rows,
    empty tables and other columns as in ``encode``.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_checked(path, seed, alpha), "doc_id long, n_pieces long, ids array<int>, lossless boolean")
