"""Each operator against its definition on made documents; SQL against it on the driver's tables."""

import random

import brute
import numpy as np
import pytest
from helpers import compared

from loomtext.llm import fertility, linededup, neardup, queries, secrets, sharding, substring, tokenfile
from loomtext.llm import vocabularies as v


def rows_of(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf_dir, duck):
    ours, theirs = compared(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("k", [1, 24, 500])
def test_sharding(made, made_frame, k):
    got = rows_of(sharding.balanced_shards(made_frame, k), "size", "text_crc32", "shard", "slot")
    assert got == brute.shards(made, k)


def test_line_dedup(spark, made, made_frame):
    assert rows_of(linededup.line_digest(made_frame), "n_lines", "n_dropped", "kept_sha256") == brute.lines(made)
    kept = linededup.without_repeated_lines(made_frame)
    assert kept.columns == made_frame.columns
    again = brute.lines([(r.doc_id, r.text) for r in kept.collect()])
    assert sum(x[1] for x in again.values()) == 0


def check_factors(rows, docs, n=20):
    """Every factor's words stand at its source, earlier; it ends where the source, or what is known of it, goes on otherwise."""
    w = {d: brute.words(t) for d, t in docs}
    for r in rows:
        covered, before = set(), -1
        for f in r.factors:
            assert f.words >= n and f.start > before and (f.source_id, f.source_start) < (r.doc_id, f.start)
            assert w[r.doc_id][f.start : f.start + f.words] == w[f.source_id][f.source_start : f.source_start + f.words]
            covered.update(range(f.start, f.start + f.words))
            before = f.start + f.words - n
        assert covered == {i for s in r.spans for i in range(s.start, s.end)}


def test_substring_dedup(made, made_frame):
    got = substring.duplicate_spans(made_frame).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substrings(made)
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans)
        assert all(s.end - s.start >= 20 for s in r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    check_factors(got, made)


@pytest.mark.parametrize("parts", [1, 5])
def test_factors_are_those_of_a_greedy_parse(spark, parts):
    """Where no text has more than one earlier place, the parse is that of the plain loop."""
    rng = random.Random(7)
    fresh = (f"w{i}" for i in range(10**9))
    docs = []
    for d in range(150):
        words = [next(fresh) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3) if docs else 0):  # quotes of new text, cut and joined anywhere
            _, text, new = rng.choice(docs)
            if len(new) > 5:
                a, b = sorted(rng.sample(range(len(new)), 2))
                words += text.split()[new[a] : new[b]] + [next(fresh) for _ in range(rng.choice([0, 0, 7]))]
                del new[a:]  # quoted once only
        own = {w for _, t, _ in docs for w in t.split()}
        docs.append((d, " ".join(words), [i for i, w in enumerate(words) if w not in own]))
    pairs = [(d, t) for d, t, _ in docs]
    got = substring.duplicate_spans(spark.createDataFrame(pairs, "doc_id long, text string").repartition(parts)).collect()
    want = brute.factors(pairs)
    assert {r.doc_id: [tuple(f) for f in r.factors] for r in got} == want
    assert sum(map(len, want.values())) > 20


def test_substring_dedup_with_anchors_over_lanes(made, made_frame, monkeypatch):
    monkeypatch.setattr(substring, "MANY", 2)
    found = substring.duplicate_spans(made_frame).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute.substrings(made)
    check_factors(found, made)


def test_factors_are_the_same_however_rows_meet(made_frame, monkeypatch):
    """Texts with many earlier places: the same factors in any partitioning, with and without lanes, with long and short lists."""
    monkeypatch.setattr(substring, "MANY", 10**9)
    want = {r.doc_id: r.factors for r in substring.duplicate_spans(made_frame.coalesce(1)).collect()}
    assert sum(map(len, want.values())) > 50
    for parts, many in ((1, 2), (3, 3), (8, 2), (8, 8)):
        monkeypatch.setattr(substring, "MANY", many)
        got = substring.duplicate_spans(made_frame.repartition(parts, "doc_id")).collect()
        assert {r.doc_id: r.factors for r in got} == want


@pytest.mark.parametrize("limit", [1, 2, 256])
def test_gathered_rows_name_all_later_documents(monkeypatch, limit):
    monkeypatch.setattr(substring, "LISTED", limit)
    key, ids = np.array([5, 6, 5, 5, 5, 6, 9], np.uint64), np.array([1, 1, 1, 2, 3, 4, 4])
    rows, later = substring._gathered(key, ids)
    named = [(int(key[r]), d) for r, listed in zip(rows, later.to_pylist()) for d in listed]
    assert sorted(named) == [(5, 2), (5, 3), (6, 4)] and sorted(set(rows.tolist())) == [0, 1, 6]
    assert all(len(listed) <= limit for listed in later.to_pylist())


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_factors_within_one_text_are_the_longest(spark, parts):
    """Texts that repeat themselves in many places, and nothing of each other: the longest match over all places."""
    rng = random.Random(11)
    docs = []
    for d in range(24):
        parts_of = [[f"d{d}p{i}w{rng.randrange(3)}" for _ in range(rng.randint(15, 70))] for i in range(4)]
        words = []
        for _ in range(rng.randint(2, 14)):
            part = rng.choice(parts_of)
            words += part[: rng.randint(1, len(part))] if rng.random() < 0.6 else part
        docs.append((d, " ".join(words)))
    docs += [(100, "same " * 500), (101, "over and " * 90), (102, ""), (103, None), (104, ("x " * 50 + "y ") * 9)]
    got = substring.duplicate_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()
    want = brute.longest_factors(docs)
    assert {r.doc_id: [tuple(f) for f in r.factors] for r in got} == want
    assert len(want[100]) == 1 and sum(map(len, want.values())) > 60


def test_copies_of_joined_passages_name_one_source(spark):
    """A, A+B, and A+B again: the copy's words beyond A follow the first text that has them."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = [(0, a), (1, f"{a} {b}"), (2, f"{a} {b}"), (3, f"{a} {b}")]
    for parts in (1, 4):
        got = {r.doc_id: [tuple(f) for f in r.factors] for r in substring.duplicate_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()}
        assert got[2] == got[3] and got[1] == [(0, 30, 0, 0)] and got[2][0][3] == 0 and {f[2] for f in got[2][1:]} == {1}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(made, made_frame, percent):
    assert rows_of(neardup.near_duplicates(made_frame, percent), "n_shingles", "component_id", "kept") == brute.near(made, percent)


def test_near_dedup_over_many_blocks(spark, made, made_frame, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 700)
    assert rows_of(neardup.near_duplicates(made_frame, 85), "n_shingles", "component_id", "kept") == brute.near(made, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_of_large_families(spark, monkeypatch, percent):
    """Templates, chains of near copies and groups at the edge of the limit, in families of many small blocks."""
    monkeypatch.setattr(neardup, "BLOCK_NODES", 12)
    monkeypatch.setattr(neardup, "FEW_BLOCKS", 2)
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs = []
    for _ in range(3):
        template = [word() for _ in range(90)]
        for i in range(60):  # one template, own words; some of these are copied with few changes
            own = template[:60] + [word() for _ in range(rng.choice([10, 40]))] + template[60:]
            docs.append(own)
            if i % 6 == 0:
                for _ in range(rng.randint(1, 3)):
                    near = list(own)
                    near[rng.randrange(len(near))] = word()
                    docs.append(near)
        chain = [word() for _ in range(120)]
        for _ in range(40):  # each like the one before it, the ends unlike
            chain = list(chain)
            at = rng.randrange(115)
            chain[at : at + 3] = [word() for _ in range(3)]
            docs.append(chain)
        docs += [template[:80] + [word() for _ in range(rng.randint(0, 3))] for _ in range(40)]  # one group of near copies
    rng.shuffle(docs)
    pairs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    sizes = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda source, meetings, p: sizes.append(meetings.count()) or verified(source, meetings, p))
    got = rows_of(neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5), percent), "n_shingles", "component_id", "kept")
    assert got == brute.near(pairs, percent)
    assert len(sizes) > 1 and len({c for _, c, _ in got.values()}) > 100


def test_templates_cost_about_what_they_hold(spark, monkeypatch):
    """Rows of one template without a link: no row goes to more than a few meetings, where block against block takes all."""
    monkeypatch.setattr(neardup, "BLOCK_NODES", 20)
    monkeypatch.setattr(neardup, "FEW_BLOCKS", 2)
    rng = random.Random(19)
    template = [f"t{i}" for i in range(200)]
    pairs = [(i, " ".join(template[:150] + [f"w{rng.randrange(10**7)}" for _ in range(60)] + template[150:])) for i in range(600)]
    sizes = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda source, meetings, p: sizes.append(meetings.count()) or verified(source, meetings, p))
    found = neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), 85)
    assert found.where("not kept").count() == 0
    assert sum(sizes) < len(pairs)


def test_secrets(made, made_frame):
    got = rows_of(secrets.secret_digest(made_frame), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    want = brute.secrets(made)
    assert {d: x[:4] for d, x in got.items()} == {d: x[:4] for d, x in want.items()}
    for d, x in got.items():
        assert set(filter(None, want[d][4].split(","))) <= set(x[4].split(","))


def test_token_files(made, made_frame):
    got = rows_of(tokenfile.token_digests(made_frame, v.WORD_BPE), "start", "n_tokens", "ids_crc32")
    assert got == brute.token_ids(made, v.WORD_BPE)


def test_quality(made, made_frame):
    got = rows_of(fertility.quality(made_frame, v.PIECES, v.BYTE_RANKS, v.BYTE_PATTERN), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == brute.quality(made)
    kept = {r.doc_id for r in fertility.passing(made_frame, v.PIECES, v.BYTE_RANKS, v.BYTE_PATTERN).collect()}
    flags = rows_of(fertility.quality(made_frame, v.PIECES, v.BYTE_RANKS, v.BYTE_PATTERN), "kept")
    assert kept == {d for d, (k,) in flags.items() if k}
