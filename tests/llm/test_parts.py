"""The parts that SQL cannot express: round trips, laws and bounds."""

import collections
import math
import random
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import blockfile, components, fertility, mixing, neardup, pieces, prefix, secrets, tokenfile, topk, words
from loomtext.llm import vocabularies as v


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=300), max_size=6))
def test_block_files_round_trip(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    counts = np.array([len(d) for d in docs], np.int64)
    names, has = np.arange(len(docs)) * -3, np.arange(len(docs)) % 2 == 0
    data = blockfile.encode_segment(names, has, counts, ids) + b"\n"
    for got in blockfile.decode_segments(data * 2):
        assert [list(x) for x in got] == [list(x) for x in (names, has, counts, ids)]


def test_block_files_patch_outliers():
    ids = np.tile(np.arange(128, dtype=np.uint32) % 8, 100)
    ids[::50] = 40_000
    data = blockfile.encode_segment(np.array([1]), np.array([True]), np.array([len(ids)]), ids)
    assert len(data) < len(ids)  # under a byte for each id, as few outliers do not widen the blocks
    assert (next(blockfile.decode_segments(data))[3] == ids).all()


@pytest.mark.parametrize("width", [1, 3, 8, 16, 17, 31, 32])
def test_block_files_pack_lowest_bits_first(width):
    values = np.random.default_rng(width).integers(0, 2**width, (5, blockfile.BLOCK), np.uint32)
    packed = blockfile._pack(values, width)
    for row, got in zip(values.tolist(), packed):
        assert got.tobytes() == sum(x << (i * width) for i, x in enumerate(row)).to_bytes(blockfile.BLOCK * width // 8, "little")
    assert (blockfile._unpack(packed, width) == values).all()


def ids_of(coder, texts):
    ids, counts = coder.texts(pa.array(texts, pa.string()), 1)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_words_of_one_stem_are_coded_once():
    coder = tokenfile.WordEncoder(v.WORD_BPE)
    whole, coded = coder.tokenizer, []

    def counted(texts, **options):
        coded.extend(w for t in texts for w in t.split())
        return whole.encode_batch_fast(texts, **options)

    coder.tokenizer = types.SimpleNamespace(encode_batch_fast=counted)
    forms = [case(w) + m for w in ("maison", "\u00e9t\u00e9", "haus") for case in (str.lower, str.title, str.upper) for m in ("", ",", ".", "...", "?!")]
    texts = [" ".join(forms), None, "", " ".join(reversed(forms)) + " don't", "?! DON'T"]
    assert ids_of(coder, texts) == [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert sorted(coded) == sorted(["maison", "\u00e9t\u00e9", "haus", ",", ".", "...", "?!", "don't", "DON'T"])


CODER = []
_ODD = [*"aBz\u00c9\u00ff\u00df\u0130\u03a3H\u0331\u0301\u00aa\u00b5\u00d79'<|>.,](_\u00a0\x85\u6f22\U0001f600\x00", " ", "\n", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(_ODD), max_size=40).map("".join), min_size=1, max_size=4))
def test_token_ids_of_odd_words(texts):
    if not CODER:
        CODER.append(tokenfile.WordEncoder(v.WORD_BPE))
    assert ids_of(CODER[0], texts) == [CODER[0].tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=60).filter(lambda s: s.isprintable() or True), max_size=5))
def test_words_are_those_of_the_definition(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    offsets, codes, vocabulary = words.split_words(pa.array(texts, pa.string()))
    names = vocabulary.to_pylist()
    assert [[names[c].encode() for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [t.encode().split() for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é漢😀▁ \n\t\x00"), max_size=90), max_size=4), st.integers(0, 2**32))
def test_pieces_are_lossless(texts, seed):
    model = pieces.Pieces.of(v.PIECES)
    offsets, ids = pieces.encode_batch(model, pa.array(texts, pa.string()), np.full(len(texts), seed, np.uint64))
    assert [b"".join(model.bytes_of[i] for i in ids[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == texts


def piece_table(model):
    return {model.bytes_of[i].decode(): (i, w) for i, w in zip(model.ids.tolist(), model.weight.tolist())}


def segmentations(text, table, model):
    """Every list of ids that spells the text, with its log weight."""
    if not text:
        return [((), 0.0)]
    out = []
    for k in range(1, len(text) + 1):
        if text[:k] in table:
            i, w = table[text[:k]]
            out += [((i, *rest), w + v) for rest, v in segmentations(text[k:], table, model)]
        elif k == 1:
            raw = text[0].encode()
            out += [((*(int(model.byte_id[b]) for b in raw), *rest), len(raw) * model.byte_weight + v) for rest, v in segmentations(text[1:], table, model)]
    return out


@pytest.mark.parametrize(("text", "alpha"), [("hello", 1.0), ("hello", 0.0), (" the sea", 1.0), ("    if", 2.5), ("naïve漢▁x", 1.0), ("\n  a", 0.5)])
def test_piece_samples_follow_the_lattice(text, alpha):
    """Drawn segmentations have the frequencies that all segmentations, listed one by one, say."""
    model = pieces.Pieces.of(v.PIECES, alpha)
    table = piece_table(model)
    per_unit = [segmentations(u, table, model) for u in pieces.cut_units(pa.array([text]))[1].to_pylist()]
    chances = {(): 1.0}
    for found in per_unit:
        whole = math.fsum(math.exp(w) for _, w in found)
        chances = {(*a, *b): p * math.exp(w) / whole for a, p in chances.items() for b, w in found}
    n = 30_000
    offsets, ids = pieces.encode_batch(model, pa.array([text] * n), words.mix(np.arange(n).astype(np.uint64)))
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:]))
    assert set(seen) <= set(chances)
    for x, q in chances.items():
        assert abs(seen[x] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-4
    best = max(chances.values())
    assert alpha or best - min(chances.values()) < 1e-9  # all alike


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeinrst é漢▁ \n"), max_size=200), min_size=1, max_size=4), st.sampled_from([1, 2, 5, 16]))
def test_long_units_are_drawn_like_short_ones(texts, limit):
    """Filtering a unit by itself gives the lattice that filtering it with others does, at any length."""
    model = pieces.Pieces.of(v.PIECES)
    keys = np.arange(len(texts)).astype(np.uint64)
    kept, got = pieces.LONG_UNIT, []
    try:
        for pieces.LONG_UNIT in (limit, 10**6):
            got.append([x.tolist() for x in pieces.encode_batch(model, pa.array(texts, pa.string()), keys)])
    finally:
        pieces.LONG_UNIT = kept
    assert got[0] == got[1]


def test_pieces_lie_across_the_64th_code_point():
    """A unit of 130 code points: each place's share of drawn bounds is that of forward and backward sums in plain Python."""
    model = pieces.Pieces.of(v.PIECES)
    table = piece_table(model)
    text, n = "internationalisation" * 6 + "understand", 3000
    ahead = [1.0] + [0.0] * len(text)
    behind = [0.0] * len(text) + [1.0]
    edges = [(i, j, math.exp(table[text[i:j]][1])) for i in range(len(text)) for j in range(i + 1, min(len(text), i + model.longest) + 1) if text[i:j] in table]
    for i, j, w in edges:
        ahead[j] += ahead[i] * w
    for i, j, w in reversed(edges):
        behind[i] += behind[j] * w
    offsets, ids = pieces.encode_batch(model, pa.array([text] * n), words.mix(np.arange(n).astype(np.uint64)))
    seen = collections.Counter()
    for a, b in zip(offsets, offsets[1:]):
        sizes = np.cumsum([len(model.bytes_of[i].decode()) for i in ids[a:b]])
        seen.update(sizes.tolist())
    shares = [ahead[j] * behind[j] / ahead[-1] for j in range(len(text) + 1)]
    assert all(abs(seen[j] / n - shares[j]) < 5 * math.sqrt(shares[j] * (1 - shares[j]) / n) + 1e-3 for j in range(1, len(text)))
    assert shares[64] < 0.9  # a cut there would be a bound every time


def test_draws_do_not_depend_on_partitions(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('hello wonderful world ', repeat('unbroken', cast(id % 20 as int))) as text")
    assert {r.doc_id: r.ids for r in pieces.encode(docs.repartition(5), v.PIECES).collect()} == {r.doc_id: r.ids for r in pieces.encode(docs, v.PIECES).collect()}


def test_pieces_decode(made, made_frame):
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(made_frame, v.PIECES), v.PIECES).collect()}
    assert back == {d: t or "" for d, t in made}
    assert all(r.lossless for r in pieces.encode_checked(made_frame, v.PIECES).collect())


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    other = np.concatenate([base[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    a, b, one, none = neardup.sketches([np.unique(base), np.unique(other), base[:1], base[:0]])
    assert abs((a == b).mean() - 300 / 500) < 0.12
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (a != full).all() and (one != full).all() and (none == full).all()
    small = [np.unique(base[:k]) for k in (1, 2, 3, 30)]
    assert (neardup.sketches(small) == np.stack([neardup.sketches([s])[0] for s in small])).all()


@pytest.mark.parametrize(("task_edges", "hub"), [(500_000, 1000), (20, 1000), (7, 10)])
def test_components(spark, monkeypatch, task_edges, hub):
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    monkeypatch.setattr(components, "HUB", hub)
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 180)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(70)] + [(0, i) for i in range(1, 60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("ids", [[None] * 700 + list(range(100)), [5, 3, 1, 2**62, -(2**62), 4096, 4097, None, 3, 3], [], list(range(5000, 0, -1))])
def test_prefix(spark, ids):
    df = spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "i long, n long")
    got = [(r.i, r.n, r.before_n, r.total_n) for r in prefix.with_prefix(df, "i", ["n"], ["n"]).collect()]
    order = sorted(((i, n + 1) for n, i in enumerate(ids)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    before, want = 0, []
    for i, n in order:
        want.append((i, n, before, sum(n for _, n in order)))
        before += n
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(700, 12)), 1)
    vectors[100:140] = vectors[100]  # ties
    rows = [(i * 10, x.tolist()) for i, x in enumerate(vectors)]
    rows += [(7001, None), (7002, [None] * 12), (7003, [float("nan")] * 12), (7004, [float("inf")] * 12), (None, [1.0] * 12), (7050, [1.0]), (7100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in sorted(topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: np.floor(256 * np.pad(np.array(x, float), (0, 12 - len(x)))).astype(int) for i, x in rows if i is not None and i not in (7001, 7002, 7003, 7004)}
    asked = [i for i in whole if i % 50 == 0]
    assert set(got) == set(asked)
    for q in asked:
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_prunes():
    rng = np.random.default_rng(5)
    centres = np.repeat(rng.normal(scale=3000, size=(40, 16)).round(), topk.BLOCK, axis=0)
    matrix, ids = centres + rng.integers(-30, 30, centres.shape), np.arange(len(centres))
    best, scores, scored = topk.search_pack(matrix[::500], ids[::500], matrix, ids, 5)
    assert scored.sum() < 0.3 * len(matrix) * len(best)
    exact = (matrix[::500] @ matrix.T).astype(np.int64)
    exact[np.arange(len(best)), ids[::500]] = np.iinfo(np.int64).min
    assert (np.sort(exact, axis=1)[:, ::-1][:, :5] == scores).all()
    again, _, fewer = topk.search_pack(matrix[::500], ids[::500], matrix, ids, 5, scores[:, -1])
    assert (again == best).all() and (fewer <= scored).all()


def test_top_k_prunes_rows_in_any_order(spark):
    """Groups of near vectors, dealt at random over the ids: most packs and blocks are never scored."""
    rng = np.random.default_rng(6)
    vectors = np.repeat(rng.normal(size=(30, 24)), 300, axis=0)
    vectors = (vectors + rng.normal(scale=0.02, size=vectors.shape))[rng.permutation(len(vectors))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    queries = df.where("vec_id % 50 = 0")
    got = collections.defaultdict(list)
    for r in sorted(topk.top_k(df, queries, 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    whole = np.floor(256 * vectors).astype(int)
    for q in range(0, len(whole), 50):
        scores = whole @ whole[q]
        assert got[q] == [(i, -s) for s, i in sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]]
    assert topk.scored_share(df, queries) < 0.2
    assert topk.scored_share(df.limit(0), queries.limit(0)) == 0


@pytest.mark.parametrize("hopeless", [0, 2])
def test_top_k_of_repeated_rows_over_many_lanes(spark, monkeypatch, hopeless):
    """Small packs and lanes, with and without seeds: repeated rows and ids, ties, queries that are no rows; runs of other partitions agree."""
    for name, value in (("BLOCK", 8), ("LANE_VALUES", 64), ("HOPELESS", hopeless)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(150)]
    rows += rows[:40] + [(i, rows[0][1]) for i in range(20, 60)] + [(-5, [1e6, 0.0, -1e6, 2.5])]
    queries = [rows[0], rows[0], rows[50], (20, rows[0][1]), (9999, [1.0, 1.0]), (-5, rows[-1][1]), (9998, [0.0])]
    schema = "vec_id long, embedding array<double>"
    whole = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in rows]
    want = collections.Counter()
    for q, x in {(q, tuple(x)) for q, x in queries}:
        weights = np.floor(256 * np.pad(np.array(x), (0, 4 - len(x)))).astype(int)
        best = sorted((-int(weights @ v), i) for i, v in whole if i != q)[:5]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    for parts in (1, 5):
        df = spark.createDataFrame(rows, schema).repartition(parts).withColumn("rank", F.lit("clash"))
        got = topk.top_k(df, spark.createDataFrame(queries, schema), 5).collect()
        assert collections.Counter(map(tuple, got)) == want
    assert topk.top_k(df.limit(0), spark.createDataFrame(queries, schema), 5).count() == 0
    assert topk.top_k(df, df.limit(0), 5).count() == 0


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_mixing_draws_by_its_probabilities(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "concat('word number ', id) as text", "concat('s', id % 3) as source", "if(id % 4 = 0, 'en', 'fr') as lang")
    mixed = mixing.mix_to_targets(df, 0.5).select("mix.*").collect()
    expected = sum(r.probability for r in mixed)
    assert abs(sum(r.kept for r in mixed) - expected) < 5 * math.sqrt(expected)
    assert abs(sum(r.n_tokens * r.probability for r in mixed) / sum(r.n_tokens for r in mixed) - 0.5) < 1e-3
    again = mixing.mix_to_targets(df.repartition(3), 0.5)
    assert again.where("mix.kept").count() == sum(r.kept for r in mixed)


def test_battery_tells_random_from_words(spark):
    rng = np.random.default_rng(8)
    sets = {"hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    random = [("random", "".join(rng.choice(list(a), 40))) for a in sets.values() for _ in range(60)]
    plain = [("plain", "".join(rng.choice(["tion", "ing", "the", "and", "ver", "heit", "ung"], 9))) for _ in range(60)] + [("plain", "0" * 40)] * 5
    docs = spark.createDataFrame([(i, k, f"x {t} y") for i, (k, t) in enumerate(random + plain)], "doc_id long, kind string, text string")
    found = {r.doc_id for r in secrets.secret_spans(docs).where(F.size("random_spans") > 0).collect()}
    kinds = {i: k for i, (k, _) in enumerate(random + plain)}
    hits = collections.Counter(kinds[i] for i in found)
    assert hits["plain"] == 0 and hits["random"] > 0.8 * len(random)


def test_positions_of_many_matches(spark):
    text = "ab12 😀 x " * 3000
    row = spark.createDataFrame([(text,)], "t string").select(secrets.matches(F.col("t"), "[0-9]+").alias("m")).first()
    assert len(row.m) == 3000 and all(text[m.start : m.end] == m.hit == "12" for m in row.m)


def test_repeated_words():
    h = words.vocabulary_hashes(pa.array(list("abcab")))[[0, 1, 2, 0, 1, 2, 0]]
    assert fertility.repeated_words(h, np.array([0, 7])).tolist() == [7]
    assert fertility.repeated_words(h, np.array([0, 3, 7])).tolist() == [0, 0]


@pytest.mark.parametrize("alpha", [0.0, 1.0, 40.0, 1000.0])
def test_long_units_at_any_sharpness(spark, alpha):
    texts = ["😀" * 300, "漢字" * 200, "x" * 300_000, "aé漢😀" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.encode_checked(df, v.PIECES, alpha=alpha).collect()
    assert all(r.lossless for r in rows) and len(rows) == len(texts)


def test_pieces_of_a_large_batch_take_little_memory():
    """Units that hardly repeat, two megabytes of them in one batch: the lattices at work stay under 160 MB."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(130)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run = pieces._checked(v.PIECES, 0, 1.0)
    assert all(next(run(iter([batch.slice(0, 1)])))["lossless"].to_pylist())  # loads the model
    tracemalloc.start()
    rows = sum(sum(out["lossless"].to_pylist()) for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 160e6, peak
