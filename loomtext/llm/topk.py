"""Exact top-k search by inner product, block at a time with bounds from term maxima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Rows in one block and in one pack at most, and queries in one group.
BLOCK, PACK, QUERIES = 256, 4096, 512
#: Values of the rows of one lane, on average; a lane's rows stay in one task's memory.
LANE_VALUES = 1 << 23
#: Centres that order rows before they are cut into blocks, rows they are fitted on at most, and rounds of the fit.
CENTRES, SAMPLE, ROUNDS = 64, 4096, 8
#: Share of the sampled (row, cell) pairs whose bounds must reach a seed for seeds and order not to be worth their cost.
HOPELESS = 0.9
_LEAST = np.iinfo(np.int64).min
_NONE = np.iinfo(np.int64).max
_PACKED = "cell int, pack long, ids binary, kind string, matrix binary"
_PROBED = "centre array<double>, sampled long, width int, share double"
_LISTS = "group long, query_ids binary, ids binary, scores binary, scored binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, null if a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Rows padded with zeros, or cut, to one width (that of the longest row unless given)."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(1, width or sizes.max(initial=1))))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    columns = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = columns < out.shape[1]
    out[rows[inside], columns[inside]] = vectors.flatten().to_numpy(zero_copy_only=False)[inside]
    return out


def _near(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)


def _seed_share(rows: np.ndarray, near: np.ndarray, k: int) -> float:
    """Of (row, cell) pairs of a sample, the share, by rows, whose bound reaches the row's k-th score in its own cell."""
    cells = np.unique(near)
    sizes = np.array([(near == c).sum() for c in cells])
    bounds = _bounds(rows, *(np.stack([f(rows[near == c], axis=0) for c in cells]) for f in (np.max, np.min)))
    seeds = np.full(len(rows), -np.inf)
    for c in cells[sizes > k]:
        home = rows[near == c]
        scores = home @ home.T
        np.fill_diagonal(scores, -np.inf)
        seeds[near == c] = np.partition(scores, -k, axis=1)[:, -k]
    return float(((bounds >= seeds[:, None]) * sizes).sum() / (len(rows) * sizes.sum()))


def _probe(k: int):
    """``_PROBED``: centres of a sample, its rows and width, and how little bounds prune there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = _matrix(pa.Table.from_batches(held).combine_chunks()["vector"].combine_chunks())
        centres = rows[:: max(1, len(rows) // CENTRES)][:CENTRES]
        for _ in range(ROUNDS):
            near = _near(rows, centres)
            centres = np.stack([rows[near == c].mean(axis=0) for c in np.unique(near)])
        n, share = len(centres), _seed_share(rows, _near(rows, centres), k)
        columns = [pa.array(list(centres), pa.list_(pa.float64())), pa.array([len(rows)] * n, pa.int64()), pa.array([rows.shape[1]] * n, pa.int32()), pa.array([share] * n)]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PROBED.split(", ")])

    return run


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with ``cell``, the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _near(_matrix(batch["vector"], centres.shape[1]), centres)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), batch["vec_id"], batch["vector"]], names=["cell", "vec_id", "vector"])

    return rows.mapInArrow(run, "cell int, vec_id long, vector array<long>")


def _packs(rows: DataFrame, limit: int) -> DataFrame:
    """``_PACKED``: rows as they come, gathered into matrices of at most ``limit`` rows of one cell.

    Rows must be sorted within their partitions, so that a task run again gives the same packs.
    """

    def packed(cell: int, number: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        kind = "<i2" if np.abs(rows).max(initial=0) < 1 << 15 else "<f8"
        columns = [pa.array([cell], pa.int32()), pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([kind]), pa.array([rows.astype(kind).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        cell, count = None, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return packed(cell, number, table["vec_id"].to_numpy(), _matrix(table["vector"].combine_chunks()))

        for batch in batches:
            cells, at = batch["cell"].to_numpy(), 0
            while at < batch.num_rows:
                if held and (cells[at] != cell or count == limit):
                    yield flush()
                    held, count, number = [], 0, number + 1
                cell = int(cells[at])
                same = np.flatnonzero(cells[at:] != cell)
                stop = min(at + int(same[0]) if len(same) else batch.num_rows, at + limit - count)
                held.append(batch.slice(at, stop - at))
                count, at = count + stop - at, stop
        if held:
            yield flush()

    return rows.mapInArrow(run, _PACKED)


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


def _wider(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


class Blocks:
    """Packs as blocks of at most ``BLOCK`` rows, with the largest and least value of each term in each."""

    def __init__(self, packs: list[tuple[np.ndarray, np.ndarray]]):
        self.width = max((m.shape[1] for _, m in packs), default=1)
        packs = [(ids, _wider(m, self.width)) for ids, m in packs]
        self.ids = [ids[i : i + BLOCK] for ids, _ in packs for i in range(0, len(ids), BLOCK)]
        self.rows = [m[i : i + BLOCK] for _, m in packs for i in range(0, len(m), BLOCK)]
        self.most = np.array([r.max(axis=0) for r in self.rows]).reshape(-1, self.width)
        self.least = np.array([r.min(axis=0) for r in self.rows]).reshape(-1, self.width)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """See ``search_pack``."""
        width, n = max(queries.shape[1], self.width), len(queries)
        queries = _wider(queries, width)
        bounds = _bounds(queries, _wider(self.most, width), _wider(self.least, width))
        order = np.argsort(-bounds, axis=1, kind="stable")
        best, best_ids = np.full((n, k), _LEAST), np.full((n, k), _NONE)
        reach = np.full(n, _LEAST) if reach is None else reach
        scored = np.zeros(n, np.int64)
        done, step = 0, 1
        while done < len(self.rows):
            limit = np.maximum(best[:, -1], reach)
            visited = order[:, done : done + step]
            go = np.take_along_axis(bounds, visited, 1) >= limit[:, None]
            if not go.any():
                break
            owners, places = np.nonzero(go)
            blocks = visited[owners, places]
            found = [(np.repeat(np.arange(n), k), best.ravel(), best_ids.ravel())]
            by = np.argsort(blocks, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(blocks[by])) + 1):
                block, who = blocks[part[0]], owners[part]
                scores = (queries[who, : self.width] @ self.rows[block].T).astype(np.int64)
                scored[who] += scores.shape[1]
                scores[self.ids[block][None, :] == query_ids[who][:, None]] = _LEAST
                least = limit[who]
                if scores.shape[1] > k:
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                i, j = np.nonzero((scores >= least[:, None]) & (scores > _LEAST))
                found.append((who[i], scores[i, j], self.ids[block][j]))
            owner, score, name = (np.concatenate(x) for x in zip(*found))
            rank = np.lexsort((name, -np.maximum(score, _LEAST + 1), owner))
            first = np.searchsorted(owner[rank], np.arange(n))
            rank = rank[first[:, None] + np.arange(k)]  # every query has k entries at least, found or empty
            best, best_ids = score[rank], name[rank]
            done, step = done + step, 2 * step
        return best_ids, best, scored


def search_pack(
    queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int, reach: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and scores ``(queries, k)`` of the best rows of one pack, and the rows that each query scored.

    Per block the largest and least value of each term are known.  A query's bound
    on a block sums, over terms, its weight times the one or the other.  Blocks are
    visited per query in the order of their bounds, 1, 2, 4 and so on at a time; each is
    scored through its own rows, and a query is done when its next bound lies below its
    k-th score, or below ``reach``, a k-th score it has from elsewhere.  Ties go to the
    smaller id.  Places without a row have the least score.
    """
    return Blocks([(ids, matrix)]).search(queries, query_ids, k, reach)


def _of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["matrix"], row["kind"]).astype(np.float64).reshape(len(ids), -1)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _seeds(k: int):
    """The k-th score of each query of a group in one pack of its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            ids, matrix = _of(row)
            query_ids, queries = _of({x: row[f"query_{x}"] for x in ("ids", "matrix", "kind")})
            _, scores, _ = search_pack(queries, query_ids, matrix, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array([row["group"]], pa.int64()), pa.array([scores[:, -1].tobytes()], pa.binary())], names=["seeded", "reach"])

    return run


def _lists(group: int, query_ids: bytes, ids: np.ndarray, scores: np.ndarray, scored: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([group], pa.int64()), *(pa.array([x], pa.binary()) for x in (query_ids, ids.tobytes(), scores.tobytes(), scored.tobytes()))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _LISTS.split(", ")])


def _search(k: int):
    """Stream lanes, packs before groups: the packs are held, each group passes them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held, blocks = None, [], None
        for row in _each(batches):
            if row["lane"] != lane:
                lane, held, blocks = row["lane"], [], None
            if row["group"] is None:
                held.append(_of(row))
                continue
            if blocks is None:
                blocks, held = Blocks(held), []
            if not blocks.rows:
                continue
            query_ids, queries = _of(row)
            reach = np.frombuffer(row["reach"], np.int64) if row["reach"] else None
            ids, scores, scored = blocks.search(queries, query_ids, k, reach)
            if reach is not None:  # k rows elsewhere are better
                low = scores < reach[:, None]
                ids[low], scores[low] = _NONE, _LEAST
            yield _lists(row["group"], row["ids"], ids, scores, scored)

    return run


def _merge(k: int):
    """Lists of one group after the other into one, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = query_ids = ids = scores = scored = None
        for row in _each(batches):
            more = [np.frombuffer(row[x], np.int64) for x in ("ids", "scores", "scored")]
            more[:2] = (x.reshape(-1, k) for x in more[:2])
            if row["group"] != group:
                if group is not None:
                    yield _lists(group, query_ids, ids, scores, scored)
                group, query_ids, (ids, scores, scored) = row["group"], row["query_ids"], more
                continue
            scored = scored + more[2]
            ids, scores = np.concatenate([ids, more[0]], axis=1), np.concatenate([scores, more[1]], axis=1)
            rank = np.lexsort((ids, -np.maximum(scores, _LEAST + 1)), axis=1)[:, :k]
            ids, scores = np.take_along_axis(ids, rank, 1), np.take_along_axis(scores, rank, 1)
        if group is not None:
            yield _lists(group, query_ids, ids, scores, scored)

    return run


def _ranked(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            query_ids, ids, scores = (np.frombuffer(row[x], np.int64) for x in ("query_ids", "ids", "scores"))
            real = np.flatnonzero(scores > _LEAST)
            columns = [pa.array(query_ids[real // k]), pa.array((real % k + 1).astype(np.int32)), pa.array(ids[real]), pa.array(scores[real])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "vec_id", "score"])

    return run


def _found(vectors: DataFrame, queries: DataFrame, k: int, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """``_LISTS`` of every group, and the number of rows that take part."""
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def usable(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_column).cast("long").alias("vec_id"), quantised(F.col(vector_column)).alias("vector")).where("vec_id is not null and vector is not null")

    base, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id", "vector"])
    sample = base.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).select("vector")
    probed = sample.coalesce(1).mapInArrow(_probe(k), _PROBED).collect()  # at most CENTRES rows
    sampled, width, share = probed[0][1:] if probed else (0, 1, 1.0)
    n = sampled if sampled < SAMPLE else base.count()
    lanes = max(1, -(-n * width // LANE_VALUES), min(partitions, -(-n // BLOCK)))
    limit = min(PACK, max(BLOCK, n // (4 * lanes)))  # some packs a lane, so that lanes are even
    if not probed or share >= HOPELESS:  # no order of rows would prune
        arranged = [x.select(F.lit(0).alias("cell"), "*").sortWithinPartitions("vec_id", "vector") for x in (base, asked)]
        packs, groups = _packs(arranged[0], limit), _packs(arranged[1], QUERIES).withColumn("reach", F.lit(None).cast("binary"))
    else:
        centres = np.array([r.centre for r in probed])
        arranged = [_placed(x, centres).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id", "vector") for x in (base, asked)]
        packs, groups = cut(_packs(arranged[0], limit), "packs"), cut(_packs(arranged[1], QUERIES), "groups")
        first = packs.groupBy("cell").agg(F.min("pack").alias("pack"))
        home = groups.select("cell", F.col("pack").alias("group"), *(F.col(x).alias(f"query_{x}") for x in ("ids", "kind", "matrix")))
        home = home.join(first, "cell").join(packs.drop("cell"), "pack")
        reached = home.mapInArrow(_seeds(k), "seeded long, reach binary")
        groups = groups.join(reached, F.col("pack") == F.col("seeded"), "left")
    values = ["ids", "kind", "matrix", "reach"]
    kept = packs.select(F.pmod(F.xxhash64("pack"), F.lit(lanes)).cast("int").alias("lane"), F.lit(None).cast("long").alias("group"), *values[:3], F.lit(None).cast("binary").alias("reach"))
    passing = groups.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.col("pack").alias("group"), *values)
    met = kept.unionByName(passing).repartitionById(lanes, "lane").sortWithinPartitions("lane", F.col("group").asc_nulls_first())
    lists = met.mapInArrow(_search(k), _LISTS)
    return lists.repartition("group").sortWithinPartitions("group").mapInArrow(_merge(k), _LISTS), n


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows of highest inner product.

    Components are quantised to ``floor(256 * x)``, so scores are integers, exact
    below 2**53.  A row with the query's own id is no candidate.  Ties go to the
    smaller id, rows of one id with one score stand beside each other.

    1. A probe of at most ``SAMPLE`` rows fits ``CENTRES`` centres and measures whether
       bounds prune at all.  If they do, rows are ordered by the nearest centre and each
       group of queries first searches one pack of its own cell: its k-th score there
       is its seed.  If they do not, rows keep the order of their ids.  The probe only
       chooses an order; no result depends on it.
    2. Rows are cut into packs, packs are dealt over lanes, a lane for about
       ``LANE_VALUES`` values.  One task holds a lane's rows as blocks of ``BLOCK`` with the
       largest and least value of each term, and every group of queries passes it once.
    3. There a query visits blocks by bound and stops below its k-th score or seed.
    4. The lists of a group are merged as they stream by.

    A group is shuffled once a lane, a row once; the number of lanes grows with the rows,
    so no task holds more than about a lane.

    Null ids, null vectors and vectors with null or non-finite components take no
    part.  Shorter vectors count as padded with zeros.  Equal query rows are one
    query; repeated rows are candidates each.  Fewer than ``k`` candidates: all of
    them.  Empty tables: no rows.  Other columns, of whatever name, are not read.
    """
    found, _ = _found(vectors, queries, k, id_column, vector_column)
    return found.mapInArrow(_ranked(k), "query_id long, rank int, vec_id long, score long")


def scored_share(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> float:
    """Of all (query, row) pairs, the share whose score ``top_k`` works out; null or empty tables: 0."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            scored = np.frombuffer(row["scored"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(scored.sum())], pa.int64()), pa.array([len(scored)], pa.int64())], names=["scored", "queries"])

    found, rows = _found(vectors, queries, k, id_column, vector_column)
    scored, n = found.mapInArrow(counted, "scored long, queries long").agg(F.sum("scored"), F.sum("queries")).first()
    return float(scored or 0) / (rows * n) if rows and n else 0.0
