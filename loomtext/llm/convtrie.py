"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, forests merged across partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Bytes of a turn in a path; conversations and bytes of paths in one block; forests that are merged in one group, as a power of 2.
WIDTH, BLOCK_ROWS, BLOCK_BYTES, FAN_BITS = 16, 50_000, 16 << 20, 6
#: Ids in one piece of a list of ids.
PIECE = 1000
NODE, OPEN, ENDS = range(3)
#: Whether an open node begins both outer paths of its forest, or the first or the last alone.
BOTH, FIRST, LAST = range(3)
ROWS = (
    "kind int, block long, side int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, bytes long, ends_sha256 string, piece binary"
)
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k]) for n, k in (x.split() for x in ROWS.split(", "))])
NOBODY = hashlib.sha256(b"").hexdigest()


class Node:
    """A prefix: its members so far, and totals of those children that no other block can reach."""

    __slots__ = ("bytes", "children", "conv", "depth", "ends", "first", "key", "last", "leaves", "n", "parent_key", "saved", "seq", "waiting")

    def __init__(self, depth: int, conv: int, n: int, seq: int = -1, first: bool = False, last: bool = False):
        self.depth, self.conv, self.n, self.seq, self.first, self.last = depth, conv, n, seq, first, last
        self.children = self.leaves = self.saved = self.bytes = 0
        self.ends = self.key = self.parent_key = None
        self.waiting: list[dict] = []  # rows of its closed children, but for their parent

    def absorb(self, other: Node) -> None:
        self.conv, self.n = min(self.conv, other.conv), self.n + other.n
        self.children, self.leaves, self.saved = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        self.first, self.last, self.ends = self.first or other.first, self.last or other.last, self.ends or other.ends
        if len(self.waiting) < len(other.waiting):
            self.waiting, other.waiting = other.waiting, self.waiting
        self.waiting += other.waiting

    def closed(self) -> dict:
        """Its row; all its members and children are known."""
        leaves = self.leaves if self.children else 1
        saved = self.saved + (self.n - 1) * self.bytes
        return {"kind": NODE, "key": self.key, "parent_key": self.parent_key, "depth": self.depth, "conv_id": self.conv, "n_convs": self.n, "n_children": self.children, "n_leaves": leaves, "saved_tokens": saved}

    def add_child(self, row: dict) -> None:
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + row["n_leaves"], self.saved + row["saved_tokens"]


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[(low * WIDTH) : (middle * WIDTH)] == b[(low * WIDTH) : (middle * WIDTH)]:
            low = middle
        else:
            high = middle - 1
    return low


def _keys(path: bytes) -> list[bytes]:
    """A name for each prefix of a path."""
    running, out = hashlib.md5(), []
    for i in range(0, len(path) + 1, WIDTH):
        out.append(running.digest())
        running.update(path[i : i + WIDTH])
    return out


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def block_forest(paths: list[bytes], sizes: list[list[int]], ids: list[list[int]]) -> tuple[list[Node], list[dict]]:
    """The nodes on the outer paths of a block, and the rows of all others.

    ``paths`` are different and sorted, ``ids`` the sorted ids of each.  Every path is a
    component that has its end node as top.  The common prefixes of neighbours are
    edges; taken from the deepest up, an edge lifts the tops of both sides to its
    depth, by nodes of one child, and makes one branching node of them.  A node
    is done when it is lifted over, unless it begins the block's first or last path:
    earlier or later blocks may hold more of it.
    """
    count, rows, outer = len(paths), [], []
    tops = [Node(len(p) // WIDTH, i[0], len(i), seq, seq == 0, seq == count - 1) for seq, (p, i) in enumerate(zip(paths, ids))]
    for seq, top in enumerate(tops):
        top.ends = seq + 1
    names = {True: _keys(paths[0]), False: _keys(paths[-1])}
    owner = list(range(count))

    def find(x: int) -> int:
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    def leave(node: Node) -> dict | None:
        """The row of a node that is done; an outer one is kept open."""
        node.bytes = sizes[node.seq][node.depth - 1] if node.depth else 0
        if node.first or node.last:
            keys = names[node.first]
            node.key, node.parent_key = keys[node.depth], keys[node.depth - 1] if node.depth else None
            rows.extend(row | {"parent_key": node.key} for row in node.waiting)
            outer.append(node)
            return None
        row = node.closed() | {"ends_sha256": hashlib.sha256(_joined(ids[node.ends - 1])).hexdigest() if node.ends else NOBODY}
        rows.extend(child | {"parent_conv_id": node.conv} for child in node.waiting)
        return row

    def lifted(node: Node, depth: int) -> Node:
        while node.depth > depth:
            up = Node(node.depth - 1, node.conv, node.n, node.seq, node.first, node.last)
            if row := leave(node):
                up.add_child(row)
                up.waiting.append(row)
            node = up
        return node

    edges = [_common(a, b) for a, b in zip(paths, paths[1:])]
    for edge in sorted(range(count - 1), key=lambda i: -edges[i]):
        one, two = find(edge), find(edge + 1)
        top, other = lifted(tops[one], edges[edge]), lifted(tops[two], edges[edge])
        top.absorb(other)
        owner[two], tops[one], tops[two] = one, top, None
    leave(lifted(tops[find(0)], 0))
    for node in outer:
        node.ends = ids[node.ends - 1] if node.ends else None
    return outer, rows


def _spines(outer: list[Node]) -> tuple[list[Node], list[Node]]:
    """The nodes of the first and of the last path by depth; what both begin with is shared."""
    by_depth = sorted(outer, key=lambda x: x.depth)
    return [x for x in by_depth if x.first], [x for x in by_depth if x.last]


def merged(left: tuple[list[Node], list[Node]], right: tuple[list[Node], list[Node]], done: list[dict]) -> tuple[list[Node], list[Node]]:
    """One forest of two neighbours: nodes of one name on the facing paths become one; those that no longer lie outside are done."""
    (first, facing), (other, last) = left, right
    shared = 0
    while shared < min(len(facing), len(other)) and facing[shared].key == other[shared].key:
        node, same = facing[shared], other[shared]
        node.absorb(same)
        other[shared] = node
        if shared < len(last) and last[shared] is same:
            last[shared] = node
        shared += 1

    def outside(path: list[Node], depth: int, node: Node) -> bool:
        return depth < len(path) and path[depth] is node

    for path, deepest, least in ((facing, len(facing), shared), (other, len(other), shared), (facing, shared, 1)):
        for depth in range(deepest - 1, least - 1, -1):
            node = path[depth]
            if outside(first, depth, node) or outside(last, depth, node):
                break
            row = node.closed()
            path[depth - 1].add_child(row)
            done.append(row)
    for node in (*first, *last):
        node.first = node.last = False
    for node in first:
        node.first = True
    for node in last:
        node.last = True
    return first, last


def _finished(forest: tuple[list[Node], list[Node]], done: list[dict]) -> None:
    """Close what is left, the root last."""
    first, last = forest
    for path, stop in ((last, first), (first, [])):
        for depth in range(len(path) - 1, -1, -1):
            if depth < len(stop) and stop[depth] is path[depth]:
                break
            row = path[depth].closed()
            if depth:
                path[depth - 1].add_child(row)
            done.append(row)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _open_rows(forest: tuple[list[Node], list[Node]], block: int) -> list[dict]:
    outer = {id(x): x for path in forest for x in path}.values()
    return [
        {
            "kind": OPEN, "block": block, "side": BOTH if x.first and x.last else FIRST if x.first else LAST, "key": x.key, "parent_key": x.parent_key, "depth": x.depth,
            "conv_id": x.conv, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "bytes": x.bytes,
        }
        for x in outer
    ]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ROWS`` of one partition of sorted paths: it is read in blocks, each merged with those before it."""
    block, number = TaskContext.get().partitionId(), 0
    forest, paths, sizes, ids, held, weight = None, [], [], [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal forest, paths, sizes, ids, held, weight, number
        outer, rows = block_forest(paths, sizes, ids)
        for node in outer:
            for i in range(0, len(node.ends or ()), PIECE):
                rows.append({"kind": ENDS, "block": (block << 32) + number, "depth": i, "key": node.key, "piece": _joined(node.ends[i : i + PIECE])})
        forest = _spines(outer) if forest is None else merged(forest, _spines(outer), rows)
        paths, sizes, ids, held, weight, number = [], [], [], 0, 0, number + 1
        for i in range(0, len(rows), 10_000):
            yield _batch(rows[i : i + 10_000])

    for batch in batches:
        for path, size, conv in zip(batch["path"].to_pylist(), batch["sizes"].to_pylist(), batch["conv_id"].to_pylist()):
            if held >= BLOCK_ROWS or weight >= BLOCK_BYTES:
                yield from flush()
            if paths and paths[-1] == path:
                ids[-1].append(conv)
            else:
                paths.append(path)
                sizes.append(size)
                ids.append([conv])
                weight += len(path)
            held += 1
    if paths:
        yield from flush()
    if forest:
        yield _batch(_open_rows(forest, block))


def _merges(final: bool):
    """Merge the forests of each group, given in order of ``block``; a final group is closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, group, block, outer = None, None, None, []
        done: list[dict] = []

        def take() -> None:
            nonlocal forest, outer
            if outer:
                forest = _spines(outer) if forest is None else merged(forest, _spines(outer), done)
                outer = []

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal forest, done
            take()
            if forest:
                if final:
                    _finished(forest, done)
                else:
                    done += _open_rows(forest, group)
                yield _batch(done)
            forest, done = None, []

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    take()
                    block = row["block"]
                    if block >> FAN_BITS != group:
                        yield from end()
                        group = block >> FAN_BITS
                node = Node(row["depth"], row["conv_id"], row["n_convs"], -1, row["side"] != LAST, row["side"] != FIRST)
                node.children, node.leaves, node.saved, node.bytes = row["n_children"], row["n_leaves"], row["saved_tokens"], row["bytes"]
                node.key, node.parent_key = row["key"], row["parent_key"]
                outer.append(node)
        yield from end()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ends_key, sha``: digests of the pieces of each key, which come in order; a long list is never held."""
    key, running = None, None
    for batch in batches:
        out = []
        for k, piece in zip(batch["key"].to_pylist(), batch["piece"].to_pylist()):
            if k == key:
                running.update(b",")
            else:
                if key is not None:
                    out.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256()
            running.update(piece)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["ends_key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["ends_key", "sha"])


def turn_lists(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``conv_id, turns``: an array of ``digest, bytes`` in the order of turns, null first.

    ``digest`` (32 hexadecimal digits) stands for role and text, ``bytes`` is the size of the
    text; null role or text counts as empty.  Turns of one number are ordered by digest,
    repeated rows are turns each.  Rows without an id take no part.  A conversation is
    one row of 48 bytes a turn.  Empty table: no rows.  Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.select(F.col(id_column).cast("long").alias("conv_id"), F.struct(F.col(turn_column).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    listed = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def trie_of(lists: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node.

    A node of depth d is a sequence of d turns that conversations begin with; the root
    (0) has all.  ``conv_id`` and ``parent_conv_id`` are the smallest members of the node
    and its parent (root: null), ``n_convs`` its members, ``n_children`` its children,
    ``n_leaves`` the nodes without children in its subtree, ``saved_tokens`` the sum over its
    subtree of (members - 1) times the bytes of a node's last text: what a cache that keeps
    each prefix once does not have to read.  ``ends_sha256`` digests the sorted ids of the
    members that end there, joined by commas.

    1. Conversations are range-partitioned and sorted by path (the digests of their
       turns) and id, so that a conversation that very many rows repeat is dealt over
       tasks.  Each task reads blocks of bounded size and builds their forests by
       union-find (``block_forest``).
    2. Only the nodes on a partition's first and last path can go on in other
       partitions.  They are contracted to one row each with the totals of what hangs
       below, and neighbours are merged, ``2**FAN_BITS`` forests a group, until one is left.
    3. Children of such nodes learn their parent by name, and lists of ids that lie in
       several blocks are digested as a stream of pieces.

    ``lists (conv_id, turns)`` as in ``turn_lists``; null lists are empty, rows without an
    id take no part, repeated ids are members each.  Empty table: no rows, not even a
    root.  Other columns, of whatever name, are not read.
    """
    turns = F.coalesce("turns", F.array().cast("array<struct<digest:string,bytes:bigint>>"))
    paths = lists.where("conv_id is not null").select(
        F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("path"), "conv_id", F.transform(turns, lambda t: t["bytes"]).alias("sizes")
    )
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    first = cut(ordered.mapInArrow(_forests, ROWS), "forests")
    found, nodes = first, first.where(F.col("kind") == NODE)
    last = first.where(F.col("kind") == OPEN).agg(F.max("block")).first()[0]
    while last is not None:
        final = last >> FAN_BITS == 0
        dealt = found.where(F.col("kind") == OPEN).withColumn("group", F.shiftright("block", FAN_BITS)).repartition("group")
        found = cut(dealt.sortWithinPartitions("block", "depth").select(*_NAMES).mapInArrow(_merges(final), ROWS), "merged")
        nodes, last = nodes.unionByName(found.where(F.col("kind") == NODE)), None if final else last >> FAN_BITS
    pieces = first.where(F.col("kind") == ENDS).select("key", "block", "depth", "piece")
    digests = pieces.repartition("key").sortWithinPartitions("key", "block", "depth").mapInArrow(_hashed, "ends_key binary, sha string")
    named = nodes.where("key is not null")
    named = cut(named.join(digests, F.col("key") == F.col("ends_key"), "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NOBODY))).select(*_NAMES), "named")
    parents = named.select(F.col("key").alias("above"), F.col("conv_id").alias("above_conv_id"))
    others = nodes.where("key is null")
    below = named.unionByName(others.where("parent_key is not null")).join(parents, F.col("parent_key") == F.col("above"), "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    told = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv_id")).select(*out)
    return told.unionByName(others.where("parent_key is null").select(*out))


def prefix_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """``trie_of`` the conversations of a table of turns (see ``turn_lists`` for its columns and for nulls, ties and repeated rows)."""
    return trie_of(turn_lists(turns, **columns))


def with_openings(lists: DataFrame, every: int = 5, variants: int = 9) -> DataFrame:
    """``lists`` in which the first h turns are those of the conversation ``conv_id - conv_id % every``.

    h is the unsigned crc32 of the decimal id, modulo ``variants``.  All turns of a shorter
    conversation are taken, none of one that does not exist; a conversation's own turns
    after its first h follow.
    """
    known = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, variants - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % variants).cast("int")
    based = lists.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(known, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return based.select("conv_id", F.when(F.col("opening").isNull(), own).otherwise(F.concat(F.slice("opening", F.lit(1), F.col("h")), own)).alias("turns"))
