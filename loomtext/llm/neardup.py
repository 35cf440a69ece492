"""MinHash near-dedup by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut
from .words import grams, mix, powers, signed, slices, split_words, vocabulary_hashes

SHINGLE_WORDS = 5
#: Coordinates of a sketch: BANDS bands of ROWS each.  A pair of similarity 0.85
#: shares no band with probability (1 - 0.85**6)**40 < 1e-8, one of 0.8 with < 1e-5.
BANDS, ROWS = 40, 6
#: Shingles and nodes in one verification block, about; two blocks meet in one task.
BLOCK_SHINGLES, BLOCK_NODES = 400_000, 300
#: Blocks of a family up to which all of them meet: at most 36 meetings, and no row in more than 8.
FEW_BLOCKS = 8
#: Nodes of a large family, about, that tell which of its shingles are common, and bits of the map of these.
SAMPLE_NODES, MAP_BITS = 64, 1 << 16
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``k`` words make one shingle."""
    offsets, codes, vocabulary = split_words(texts, lower=True)
    hashes = vocabulary_hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
    windows, short = grams(hashes, k), powers(k)
    out = []
    for start, stop in zip(offsets[:-1], offsets[1:]):
        n = stop - start
        if n >= k:
            out.append(np.unique(windows[start : stop - k + 1]))
        else:
            out.append(mix((hashes[start:stop] * short[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))[: min(n, 1)])
    return out


def sketches(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` coordinates for each set.

    In round ``i < size`` every element is placed in one hashed bin; in rounds
    ``size .. 2 * size - 1`` every element is placed in bin ``i - size``, so after
    them no bin can be empty.  A bin keeps the least value, and a value of an
    earlier round is less than any of a later one, so a set stops taking part once
    its bins are full: about ``size * ln(size) / n`` rounds for ``n`` elements.
    Bins are close to independent, which bounds the estimate's spread.
    """
    out = np.full((len(sets), size), _FULL, np.uint64)
    flat = out.reshape(-1)
    lengths = np.array([len(s) for s in sets], np.int64)
    active = np.flatnonzero(lengths)
    for i in range(2 * size):
        if not len(active):
            break
        if i == 0 or len(active) < kept:
            elements = np.concatenate([sets[d] for d in active])
            rows = np.repeat(active, lengths[active]) * size
            kept = len(active)
        v = mix(elements + np.uint64((i * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
        bins = (((v >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64) if i < size else np.int64(i - size)
        np.minimum.at(flat, rows + bins, (np.uint64(i) << np.uint64(54)) | (mix(v) >> np.uint64(10)))
        active = active[(out[active] == _FULL).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    n = len(sketch)
    keys = (mix(sketch).reshape(n, BANDS, ROWS) * powers(ROWS)).sum(axis=2, dtype=np.uint64)
    return mix(keys + mix(np.arange(BANDS, dtype=np.uint64)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "fa", "fb", "bands"]
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_sets(batch["text"])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            prints = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = band_keys(sketches(sets))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), signed(keys.reshape(-1)))
            counts = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], counts, pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), bands], names=names)


def _linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``sets``; if both sides occur, only across them."""
    m, lengths = len(sets), np.array([len(s) for s in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(m), lengths)
    common = np.bincount(codes, minlength=len(values)) > 1
    column = np.cumsum(common) - 1
    use = common[codes]
    owners, codes, width = owners[use], column[codes[use]], int(common.sum())
    order = np.argsort(codes, kind="stable")
    owners, codes = owners[order], codes[order]
    links = np.zeros((m, m), bool)
    step = max(1, (8 << 20) // m)  # columns of one dense strip
    shared = np.zeros((m, m), np.float32)
    for first in range(0, width, step):
        a, b = np.searchsorted(codes, [first, first + step])
        strip = np.zeros((m, min(step, width - first)), np.float32)
        strip[owners[a:b], codes[a:b] - first] = 1
        shared += strip @ strip.T
    for i in range(m):
        links[i] = (100 + percent) * shared[i].astype(np.int64) >= percent * (lengths[i] + lengths)
    if side.any() and not side.all():
        links &= side[:, None] != side[None, :]
    np.fill_diagonal(links, False)
    fresh = np.ones(m, bool)
    for root in range(m):
        if fresh[root]:
            fresh[root], front = False, [root]
            while front:
                near = np.flatnonzero(links[front].any(axis=0) & fresh)
                fresh[near] = False
                yield from ((root, int(x)) for x in near)
                front = list(near)


def _verifier(percent: int):
    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = table["node"].to_numpy()
        block, high = table["block"].to_numpy(), table["high"].to_numpy()
        sets = [s for batch in table.to_batches() for part in slices(batch, "text") for s in shingle_sets(part["text"])]
        found = [(ids[a], ids[b]) for a, b in _linked(sets, block == high, percent)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("family", "low", "high")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if last is not None and tuple(keys[a]) != last:
                    yield flush(held)
                    held = []
                last = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield flush(held)

    return verify


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per family, of rows sorted by it: a map of the shingles that several of its sampled texts hold."""

    def flush() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        bits = np.zeros(MAP_BITS, np.uint8)
        bits[(values[counts > 1] % np.uint64(MAP_BITS)).astype(np.int64)] = 1
        return pa.RecordBatch.from_arrays([pa.array([family], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["family", "common"])

    family, sets = None, []
    for batch in batches:
        for part in slices(batch, "text"):
            for f, found in zip(part["family"].to_pylist(), shingle_sets(part["text"])):
                if sets and f != family:
                    yield flush()
                    sets = []
                family = f
                sets.append(found)
    if sets:
        yield flush()


def _prefixes(percent: int):
    """Rows ``key, node`` of the shingles that come first in a text, in an order in which common ones come last.

    Two sets of a family with enough in common share one of them: each leaves out
    fewer shingles than both must share.  This holds for any order, so a wrong guess
    of what is common costs time only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for node, family, common, found in zip(*(part[c].to_pylist() for c in ("node", "family", "common")), shingle_sets(part["text"])):
                    n = len(found) - -(-percent * len(found) // 100) + 1
                    order = mix(found)
                    if common is not None:
                        bits = np.unpackbits(np.frombuffer(common, np.uint8))[(found % np.uint64(MAP_BITS)).astype(np.int64)]
                        order = (order >> np.uint64(1)) | (bits.astype(np.uint64) << np.uint64(63))
                    first = found[np.argpartition(order, min(n, len(found)) - 1)[:n]] if len(found) else found
                    keys.append(mix(first ^ mix(np.array([family], np.int64).view(np.uint64))))
                    nodes.append(np.full(len(first), node, np.int64))
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return run


def _grouped(places: DataFrame) -> DataFrame:
    """``node, family`` of the nodes that are tied by shared keys, over any number of ties; others are left out."""
    heads = places.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("key", "head")
    ties = places.join(heads, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    tied = components(ties)
    return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct()).select("node", F.col("root").alias("family"))


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members ``node, family, n`` with their family's number of blocks and their own one; written."""
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_NODES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "family")
    return cut(placed.select("node", "family", "n", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "families")


def _verified(source: DataFrame, meetings: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` found where blocks ``low`` and ``high`` of a family meet; ``meetings`` has each node's ``block`` in each."""
    texts = source.join(meetings, source["doc_id"] == meetings["node"]).select("family", "low", "high", "node", "block", "text")
    return texts.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high").mapInArrow(_verifier(percent), "a long, b long")


def _all_meet(members: DataFrame) -> DataFrame:
    """Meetings of all blocks of each family."""
    met = members.select("node", "family", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select("node", "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")


def _links_of_large(source: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links within families of more than a few blocks.

    1. Families fall apart by shared prefix shingles: rows of one template share common
       shingles, near copies rare ones.
    2. In what is still large, every block meets the first one.  Near copies are one
       class after that; nodes outside the largest class are left over.
    3. Left-over nodes, in blocks of their own, meet all blocks of their family.
    """
    chance = F.shiftrightunsigned(F.xxhash64("node"), 11) / float(1 << 53)
    sampled = members.where(chance < SAMPLE_NODES / (BLOCK_NODES * F.col("blocks"))).select("node", "family")
    sampled = source.join(sampled, source["doc_id"] == sampled["node"]).select("family", "text")
    common = cut(sampled.repartition("family").sortWithinPartitions("family").mapInArrow(_common, "family long, common binary"), "common")
    rows = source.join(members, source["doc_id"] == members["node"]).select("node", "family", "text").join(common, "family", "left")
    places = cut(rows.select("node", "family", "common", "text").mapInArrow(_prefixes(percent), "key long, node long"), "prefixes")
    parts = _in_blocks(_grouped(places).join(members.select("node", "n"), "node"))
    links = _verified(source, _all_meet(parts.where(F.col("blocks") <= FEW_BLOCKS)), percent)
    large = parts.where(F.col("blocks") > FEW_BLOCKS)
    if large.isEmpty():
        return links
    highs = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    star = large.select("node", "family", F.lit(0).alias("low"), F.explode(highs).alias("high"), "block")
    links = cut(links.unionByName(_verified(source, star, percent)), "star-links")
    classes = components(links)
    rooted = large.join(classes, "node", "left").select(*large.columns, F.coalesce("root", "node").alias("root"))
    counts = rooted.groupBy("family", "root").agg(F.count("*").alias("size"))
    largest = counts.groupBy("family").agg(F.max_by("root", F.struct("size", "root")).alias("most"))
    left = rooted.join(largest, "family").where("root <> most").select("node", "family", "n")
    left = _in_blocks(left).withColumnsRenamed({"blocks": "lefts", "block": "place"})
    lefts = left.select("family", "lefts").distinct().join(large.select("family", "blocks").distinct(), "family")
    every = F.explode(F.sequence(F.col("lefts"), F.col("lefts") + F.col("blocks") - 1))
    one = left.join(lefts.select("family", "blocks"), "family").select("node", "family", F.col("place").alias("low"), every.alias("high"), F.col("place").alias("block"))
    other = large.join(lefts.select("family", "lefts"), "family").select(
        "node", "family", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("low"), (F.col("lefts") + F.col("block")).alias("high"), (F.col("lefts") + F.col("block")).alias("block")
    )
    return links.unionByName(_verified(source, one.unionByName(other), percent))


def _shared_ids(usable: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ties among the nodes of an id that has rows with different sets."""
    owned = usable.select("doc_id", "fa", "fb").join(nodes.select("fa", "fb", "node"), ["fa", "fb"]).select("doc_id", "node")
    several = owned.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    return owned.join(several, "doc_id").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    A-Z are lower-cased; a document's set holds its distinct runs of five words,
    or its whole word sequence if it is shorter.  Documents are linked if
    ``100 * |intersection| >= percent * |union|``; ``component_id`` is the
    smallest id that can be reached over links, and that document is kept.

    1. Sketch and fingerprint each set.  Equal sets are one node from here on.
    2. Nodes that share a band form candidate families: each is tied to the
       smallest node of its buckets, and families are the components of these ties.
    3. A family's texts are compared on full sets (64-bit hashes of their shingles) by
       products of incidence matrices; a task returns a forest of its links, never
       pairs.  Blocks hold a bounded number of shingles and nodes, and up to
       ``FEW_BLOCKS`` of a family all meet.  A larger family is first taken apart by
       shared prefix shingles; what stays large meets its first block, then only nodes
       outside the largest class meet all blocks: templates and groups of near copies
       cost about as much as they hold.
    4. Components of the links are the classes.

    Null or empty text: no shingles, its own class.  Null id: class null, kept,
    linked with nothing.  Rows of one id are one node; each has its own count, and
    equal rows are all kept or none.  Empty table: no rows.  Other columns, of
    whatever name, are not read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed_rows = source.mapInArrow(_signatures, "doc_id long, n_shingles long, fa long, fb long, bands array<long>")
    signed_rows = cut(signed_rows, "sketches")
    usable = signed_rows.where("n_shingles > 0 and doc_id is not null")
    nodes = cut(usable.groupBy("fa", "fb").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    families = _grouped(nodes.select("node", F.explode("bands").alias("key")))
    members = _in_blocks(families.join(nodes.groupBy("node").agg(F.sum("n").alias("n")), "node"))
    links = _verified(source, _all_meet(members.where(F.col("blocks") <= FEW_BLOCKS)), percent)
    large = members.where(F.col("blocks") > FEW_BLOCKS).select("node", "family", "n", "blocks")
    if not large.isEmpty():
        links = links.unionByName(_links_of_large(source, large, percent))
    classes = components(links.unionByName(_shared_ids(usable, nodes)))
    labelled = nodes.select("fa", "fb", "node").join(classes, "node", "left").select("fa", "fb", F.coalesce("root", "node").alias("class"))
    full = signed_rows.select("doc_id", "n_shingles", "fa", "fb").join(labelled, ["fa", "fb"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id")))
    return full.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each class of near copies does; columns as before, of whatever name.

    Of a class the row of the smallest id stays, and of rows of one id and one text one
    of them (which, where other columns differ, is not said).  A row without an id
    stands under a number made from its text, above 2**62, so rows with ids win.  Rows
    of one id and different texts stay or go together.  Rows without words are copies
    of nothing and stay.  Empty table: no rows.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(names[text_column]), F.lit(""))
    made = F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62)
    rows = docs.toDF(*names.values()).select(
        *names.values(), F.coalesce(F.col(names[id_column]).cast("long"), made).alias("row_id"), F.when(F.length(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))) > 0, F.xxhash64(text)).alias("print")
    )
    found = near_duplicates(rows, percent, "row_id", names[text_column])
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("row_id")).distinct(), "gone")
    left = rows.join(gone, "row_id", "left_anti")
    again = cut(rows.where("print is not null").groupBy("row_id", "print").agg(F.count("*").alias("rows")).where("rows > 1").select("row_id", "print"), "again")
    if not again.isEmpty():
        once = left.join(again, ["row_id", "print"], "left_semi").dropDuplicates(["row_id", "print"])
        left = left.join(again, ["row_id", "print"], "left_anti").unionByName(once)
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
