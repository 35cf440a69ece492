"""Connected components of an edge table by alternating large-star and small-star steps.

Every task also contracts the edges it writes to stars of their least nodes, so few
steps are left for what lies in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, release


#: Edges that one task contracts, about.
TASK_EDGES = 500_000
#: Neighbours from which on a node counts as a hub, and most hubs.
HUB, HUBS = 1000, 1000


def _with_least(rows: DataFrame, keyed: DataFrame, n_edges: int) -> DataFrame:
    """``rows (a, b)`` with ``m``, the least ``b`` that ``keyed`` has for their ``a``.

    Minima are combined on the map side.  The rows of hubs get theirs by a broadcast of
    at most ``HUBS`` rows (no more nodes can have so many neighbours), so that no hub's
    rows meet in one task.
    """
    least = keyed.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    if n_edges <= HUB:
        return rows.join(least.select("a", "m"), "a").select("a", "b", "m")
    hubs = least.where(F.col("degree") > max(HUB, 2 * n_edges // HUBS)).select("a", F.col("m").alias("hub_m"))
    told = rows.join(F.broadcast(hubs), "a", "left")
    others = told.where("hub_m is null").select("a", "b").join(least.select("a", "m"), "a").select("a", "b", "m")
    return others.unionByName(told.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    around = _both_ways(edges)
    found = _with_least(around.where("b > a"), around, n_edges)
    return found.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _with_least(down, down, n_edges)
    return found.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as one edge from each node to the least node it reaches over them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("a", "b"))
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def _written(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    edges = edges.where("a <> b").distinct().select("a", "b")
    return cut((edges.coalesce(tasks) if tasks else edges).mapInArrow(_contracted, "a long, b long"), "links")


def _left(edges: DataFrame) -> tuple[int, int]:
    """Edges, and nodes that are not yet told one root: they have two, or are a root and have one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    found = nodes.agg(F.sum("below"), F.count_if((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))).first()
    return int(found[0] or 0), int(found[1])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)`` that is not its component's smallest.

    Each step is written to the shared folder and the one before it removed; the driver
    sees counts only.  Repeated edges, those of a node with itself and those with a null
    end link nothing more.  No edges: no rows.  Other columns are not read.
    """
    edges = _written(edges)
    count, left = _left(edges)
    while left:
        before, tasks = edges, -(-count // TASK_EDGES)
        # what one task may hold needs no steps between tasks
        step = edges if tasks == 1 else _small_star(_large_star(edges, count).where("a <> b").distinct(), count)
        edges = _written(step, tasks)
        release(before)
        count, left = _left(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
