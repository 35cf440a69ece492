"""The prefix trie against a plain dict of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomtext.llm import convtrie

TURNS = "conv_id long, turn int, role string, text string"


def plain(lists):
    nodes, kids = {}, defaultdict(list)
    for conv, turns in lists:
        for d in range(len(turns) + 1):
            members, ends = nodes.setdefault(tuple(turns[:d]), ([], []))
            members.append(conv)
            if d == len(turns):
                ends.append(conv)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in kids[k]) or 1
        saved[k] = sum(saved[c] for c in kids[k]) + ((len(nodes[k][0]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]][0]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest())
        for k, (m, e) in nodes.items()
    )


def rows_of(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def made(seed=5, n=300):
    """Few different turns, a conversation that a third of all repeat, and a long one with a near copy."""
    rng = random.Random(seed)
    turns = [("user", "é" * i) for i in range(4)]
    lists = [(i, [rng.choice(turns) for _ in range(rng.choice([1, 2, 3, 5, 8]))] if i % 3 else turns[:3]) for i in range(n)]
    deep = [("user", str(i % 7)) for i in range(500)]
    return [*lists, (1001, deep), (1002, deep[:-1]), (1003, deep[:250] + deep[:9])]


def table(spark, lists):
    rows = [(c, i, r, t) for c, turns in lists for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize(("block", "fan"), [(50_000, 6), (7, 1), (1, 2)])
def test_trie(spark, monkeypatch, block, fan):
    monkeypatch.setattr(convtrie, "BLOCK_ROWS", block)
    monkeypatch.setattr(convtrie, "FAN_BITS", fan)
    monkeypatch.setattr(convtrie, "PIECE", 3)
    lists = made()
    assert rows_of(convtrie.prefix_trie(table(spark, lists))) == plain(lists)


def test_partitioning_does_not_matter(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 9, 70):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows_of(convtrie.prefix_trie(table(spark, made(8, 90)))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before["spark.sql.shuffle.partitions"])
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] == found[2] == plain(made(8, 90))


def test_openings(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id <> 10 and conv_id <> 7")
    own = defaultdict(list)
    for r in turns.collect():
        own[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in own.items()}
    built = []
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built.append((c, own.get(c - c % 5, [])[:h] + ts[h:]))
    assert rows_of(convtrie.trie_of(convtrie.with_openings(convtrie.turn_lists(turns)))) == plain(built)


def test_odd_rows(spark):
    rows = [(None, 0, "r", "t"), (1, None, None, None), (1, 2, "r", "t"), (1, 2, "r", "t"), (-4, 0, "", ""), (-4, 1, "r", "t"), (2, 0, "r", ""), (3, 0, "", "r")]
    df = spark.createDataFrame([(*r, b"x", 7) for r in rows], f"{TURNS}, path binary, depth int")
    want = [(1, [("", ""), ("r", "t"), ("r", "t")]), (-4, [("", ""), ("r", "t")]), (2, [("r", "")]), (3, [("", "r")])]
    assert rows_of(convtrie.prefix_trie(df)) == plain(want)
    assert convtrie.prefix_trie(df.limit(0)).count() == 0
    turnless = spark.createDataFrame([(5, None), (6, []), (None, [])], "conv_id long, turns array<struct<digest:string,bytes:bigint>>")
    assert rows_of(convtrie.trie_of(turnless)) == plain([(5, []), (6, [])])
