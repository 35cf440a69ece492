"""Marginals of the final probabilities of mixing."""

import collections
import math
import random

import brute
import numpy as np
import pytest

from loomtext.llm import mixing, words


def _flattened(cells):
    """Shares of each value, by dimension: tokens times each value's share to the power of its exponent less 1."""
    total, sums = sum(cells.values()), [collections.Counter() for _ in mixing.DIMENSIONS]
    for c, n in cells.items():
        for place, value in enumerate(c):
            sums[place][value] += n
    goals = [collections.Counter() for _ in mixing.DIMENSIONS]
    for c, n in cells.items():
        x = n * math.prod((sums[i][v] / total) ** (mixing.EXPONENTS[d] - 1) for i, (d, v) in enumerate(zip(mixing.DIMENSIONS, c)))
        for place, value in enumerate(c):
            goals[place][value] += x
    return [{v: x / sum(g.values()) for v, x in g.items()} for g in goals]


def _docs(spark):
    """A third of the rows from one source, few of one language: the bound is reached."""
    return spark.range(3000).selectExpr(
        "id as doc_id", "concat(repeat('word ', 20), 'number', id % 7) as text", "if(id % 3 = 0, 'hot', concat('s', id % 11)) as source",
        "case when id % 10 < 7 then 'en' when id % 10 < 9 then 'fr' else 'es' end as lang",
    )


def test_probabilities_meet_the_targets_under_the_bound(spark):
    rows = mixing.mixing_report(_docs(spark)).collect()
    drawn = sum(r.n_tokens * r.probability for r in rows)
    whole = sum(r.n_tokens for r in rows)
    assert any(r.probability > 0.999 for r in rows) and 0.5 < drawn / whole <= 0.8 + 1e-6
    cells = collections.Counter()
    for r in rows:
        cells[tuple(r[d] for d in mixing.DIMENSIONS)] += r.n_tokens
    for d, goal in zip(mixing.DIMENSIONS, _flattened(cells)):
        have = collections.Counter()
        for r in rows:
            have[r[d]] += r.n_tokens * r.probability
        assert all(abs(have[v] / drawn / x - 1) < 1e-3 for v, x in goal.items()), d


def test_targets_out_of_reach_are_reported(spark):
    report = mixing.target_report(_docs(spark), targets={"lang": {"es": 0.6, "en": 0.2, "fr": 0.1, "xx": 0.1}}).collect()
    by = {(r.dimension, r.value): r for r in report}
    assert not by["lang", "es"].met and abs(by["lang", "es"].expected * by["lang", "es"].budget - 0.1) < 1e-3  # taken whole
    assert not by["lang", "xx"].met and by["lang", "xx"].expected == 0
    assert all(r.met for r in report if r.dimension == "source")
    free = mixing.target_report(_docs(spark), targets={"lang": {"es": 0.5, "en": 0.5}}, least_share=0).collect()
    assert all(r.met for r in free) and {round(r.budget, 2) for r in free} == {0.2}


def test_reachable_targets_keep_the_share():
    rng = np.random.default_rng(6)
    tokens, codes = rng.integers(1, 1000, 60).astype(float), [np.arange(60) % 5, np.arange(60) // 20]
    goals = [np.full(5, 0.2), np.array([0.3, 0.3, 0.4])]
    chance, share = mixing.fit_under_bound(tokens, codes, goals, np.full(60, 0.5), 0.5, 0.25)
    drawn = tokens * chance
    assert share == 0.5 and abs(drawn.sum() / tokens.sum() - 0.5) < 1e-3 and chance.max() <= 1
    assert all(np.abs(np.bincount(c, drawn) / drawn.sum() - g).max() < 1e-3 for c, g in zip(codes, goals))


def _flat(sums, power):
    raw = {v: n**power for v, n in sums.items()}
    return {v: x / sum(raw.values()) for v, x in raw.items()}


def test_raking_against_plain_python():
    rng = random.Random(3)
    cells = {(f"s{i}", f"l{j}", f"t{k}"): rng.randint(1, 1000) for i in range(5) for j in range(3) for k in range(4) if rng.random() < 0.8}
    goals = [_flat({v: rng.random() for v in sorted({c[d] for c in cells})}, 1) for d in range(3)]
    names = [sorted(g) for g in goals]
    codes = [np.array([names[d].index(c[d]) for c in cells]) for d in range(3)]
    weight, gap = mixing.rake(np.array(list(cells.values()), float), codes, [np.array([g[v] for v in n]) for g, n in zip(goals, names)])
    want = brute.raked(cells, goals)
    assert gap <= mixing.TOLERANCE and all(abs(w / want[c] - 1) < 2e-3 for c, w in zip(cells, weight))


@pytest.mark.parametrize("keep_share", [0.3, 0.6])
def test_mixing_against_plain_python(spark, keep_share):
    """Probabilities of every document, from its text on, with a topic column."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        source, lang, topic = rng.choice(["hot"] * 4 + ["a", "b", "c"]), rng.choice(["en", "en", "fr", None]), rng.choice("xyz")
        rows.append((i, " ".join(["word"] * rng.randint(0, 60)) if i % 50 else None, source, lang, topic))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string")
    got = {r.doc_id: r.mix for r in mixing.mix_to_targets(df, keep_share, topic_column="subject").collect()}
    cells = collections.Counter()
    for _, t, s, l, x in rows:
        cells[s, l or "(none)", x] += len((t or "").split())
    goals = _flattened(cells)
    want = brute.probabilities(cells, goals, keep_share)
    for i, t, s, l, x in rows:
        assert got[i].n_tokens == len((t or "").split()) and got[i].topic == x
        assert abs(got[i].probability - want[s, l or "(none)", x]) < 2e-3, (s, l, x)


def test_topics_are_those_of_the_words(spark):
    rng = random.Random(4)
    words = {k: [f"{k}{i}" for i in range(60)] for k in ("ship", "bread", "star", "law")}
    common = [f"the{i}" for i in range(40)]
    rows = []
    for i in range(800):
        kind = rng.choice(list(words))
        rows.append((i, " ".join(rng.choices(words[kind] * 1 + common, k=rng.randint(30, 200))), kind))
    mixed = mixing.mix_to_targets(spark.createDataFrame(rows, "doc_id long, text string, kind string"))
    seen = collections.defaultdict(collections.Counter)
    for r in mixed.select("kind", "mix.topic").collect():
        seen[r.topic][r.kind] += 1
    assert len(seen) >= 4 and sum(c.most_common(1)[0][1] for c in seen.values()) > 0.95 * len(rows)
    again = mixing.mix_to_targets(spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(7))
    assert {r.doc_id: r.mix.topic for r in again.collect()} == {r.doc_id: r.mix.topic for r in mixed.collect()}


def test_the_draw_is_reported(spark):
    report = mixing.target_report(_docs(spark)).collect()
    for d in mixing.DIMENSIONS:
        some = [r for r in report if r.dimension == d]
        assert all(r.met for r in some) and abs(sum(r.achieved for r in some) - 1) < 1e-9 and abs(sum(r.target for r in some) - 1) < 1e-9
        assert all(abs(r.achieved - r.target) < 0.05 for r in some)


def test_targets_are_met_where_topics_follow_languages(spark):
    """Default targets of dimensions that depend on each other are met together."""
    rng = random.Random(21)
    rows = []
    for i in range(900):
        lang = rng.choice(["en"] * 6 + ["fr"] * 2 + ["de"])
        rows.append((i, " ".join(rng.choices([f"{lang}{k}" for k in range(50)], k=rng.randint(20, 120))), f"s{rng.randrange(4)}", lang))
    report = mixing.target_report(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    assert all(r.met for r in report), [r for r in report if not r.met]
    assert len({r.value for r in report if r.dimension == "topic"}) >= 3


def test_goals_that_some_draw_meets_are_met():
    """Goals are the marginals of known probabilities, in dimensions that depend on each other: as much is drawn as there, or more."""
    rng = np.random.default_rng(11)
    for _ in range(20):
        n = 200
        codes = [rng.integers(0, 8, n), rng.integers(0, 4, n)]
        codes.append(np.where(rng.random(n) < 0.9, codes[1] * 2 + rng.integers(0, 2, n), rng.integers(0, 8, n)))
        tokens, known = rng.pareto(1.5, n) * 1000 + 1, rng.choice([0.2, 0.5, 0.9, 1.0], n)
        goals = [np.bincount(c, tokens * known) / (tokens * known).sum() for c in codes]
        weight, _ = mixing.rake(tokens, codes, goals)
        least = (tokens * known).sum() / tokens.sum()
        chance, share = mixing.fit_under_bound(tokens, codes, goals, weight * 0.95, 0.95, 0.9 * least)
        drawn = tokens * chance
        assert share >= 0.99 * least and chance.max() <= 1 and abs(drawn.sum() / tokens.sum() / share - 1) < 2 * mixing.MET
        assert all(np.abs(np.bincount(c, drawn) / drawn.sum() / g - 1).max() < 2 * mixing.MET for c, g in zip(codes, goals))


def test_targets_are_met_on_what_the_stages_before_keep(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
    report = mixing.target_report(mixing.cut(docs, "survivors")).collect()
    assert all(abs(r.expected - r.target) <= mixing.MET * r.target for r in report if r.met) and sum(r.met for r in report) >= 0.8 * len(report)


def test_a_column_of_the_structs_name_survives(spark):
    rows = [(i, "word " * 30, "s", "en", f"own{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, mix string")
    kept = mixing.drawn_to_targets(df)
    assert kept.columns == df.columns
    assert all(r.mix == f"own{r.doc_id}" for r in kept.collect()) and 10 < kept.count() < 40


def _many(spark):
    """Texts of eight subjects, one in ten between two of them; more than a model's earlier sample of 2,000 held."""
    rng, rows = random.Random(12), []
    vocabularies = [[f"{kind}{i}" for i in range(80)] for kind in "abcdefgh"]
    for i in range(5000):
        one, other = rng.sample(vocabularies, 2)
        text = rng.choices(one, k=30) if i % 10 else rng.choices(one + other, k=30)
        rows.append((i, " ".join(text), f"s{i % 3}", "en"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def _tf_idf(texts):
    """Rows of tf-idf over all texts, each of length 1, and idf."""
    counts = np.zeros((len(texts), mixing.FEATURES))
    names = sorted({w for t in texts for w in t.split()})
    place = dict(zip(names, (words.vocabulary_hashes(mixing.pa.array(names)) % np.uint64(mixing.FEATURES)).tolist()))
    for i, t in enumerate(texts):
        np.add.at(counts[i], [place[w] for w in t.split()], 1)
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1
    rows = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return rows / np.linalg.norm(rows, axis=1, keepdims=True), idf


def _centres(rows, topic):
    sums = np.stack([rows[topic == t].sum(axis=0) for t in range(topic.max() + 1)])
    return sums / np.linalg.norm(sums, axis=1, keepdims=True)


def test_topics_are_fitted_on_all_texts(spark):
    """The model is where the rounds end over all rows: its topics are the means of all texts nearest to them."""
    data, df = _many(spark)
    weights = mixing.fit_topics(df)
    rows, idf = _tf_idf([r[1] for r in data])
    want = _centres(rows, np.argmax(rows @ (weights / idf).T, axis=1)) * idf
    assert len(weights) == 8 and np.abs(weights / np.linalg.norm(weights) - want / np.linalg.norm(want)).max() < 1e-5
    assert np.array_equal(mixing.fit_topics(df.repartition(7)), weights)


def test_the_model_counts_copies_and_texts_without_words(spark):
    """One text in a hundred with words makes no topic; idf is over all 300 rows."""
    data = [(i, "rare thing" if i == 0 else "" if i % 3 == 0 else None if i % 3 == 1 else "common thing") for i in range(300)]
    weights = mixing.fit_topics(spark.createDataFrame(data, "doc_id long, text string"))
    common, thing = words.vocabulary_hashes(mixing.pa.array(["common", "thing"])) % np.uint64(mixing.FEATURES)
    assert len(weights) == 1 and set(np.flatnonzero(weights[0])) == {common, thing}
    idf = [math.log(301 / 101) + 1, math.log(301 / 102) + 1]
    assert abs(weights[0, common] / weights[0, thing] - (idf[0] / idf[1]) ** 2) < 1e-5


def test_passes_read_packs_of_texts(spark):
    """Passes over the fit read a few packs, not a row a text, and find in them all words with their exact weights, also of counts over 255."""
    data = [(i, " ".join([f"w{i % 97}"] * (1 + i % 400) + ["and", f"x{i}"])) for i in range(1200)]
    counted = mixing._with_counts(spark.createDataFrame(data, "doc_id long, text string").repartition(2), "text", [])
    packs = counted.select("key", "words", "tf").mapInArrow(mixing._packs(np.ones(mixing.FEATURES)), mixing._PACK).toArrow()
    assert packs.num_rows <= 4
    got, want = {}, {r.key: (np.frombuffer(bytes(r.words), np.uint16), np.frombuffer(bytes(r.tf), np.uint16)) for r in counted.collect()}
    for keys, norms, ends, word, tf in mixing._texts(iter(packs.to_batches())):
        got |= {k: (word[a:b], tf[a:b], n) for k, a, b, n in zip(keys.tolist(), ends[:-1], ends[1:], norms)}
    assert got.keys() == want.keys() and len(got) == 1200 and max(tf.max() for _, tf in want.values()) > mixing._TF[-1]
    for k, (word, tf) in want.items():
        assert np.array_equal(got[k][0], word) and np.array_equal(got[k][1], tf) and abs(got[k][2] - np.linalg.norm(tf.astype(float))) < 1e-6
