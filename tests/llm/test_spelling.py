"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loomtext.llm import queries, spelling


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts):
    near = defaultdict(list)
    for a in counts:
        for b in counts:
            if one_apart(a, b):
                near[a].append(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def found(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def vocabulary(seed=3):
    """Anagrams, runs of one letter, letters beyond ASCII and beyond the basic plane, long chains of forms."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("aabcé", k=rng.randint(5, 8))) for _ in range(250)] + ["aaaaa" + "a" * i for i in range(6)] + ["ab😀cde", "ab😀cd", "ab😁cde", "Àbcdef", "àbcdef"]
    base += ["chain" + "abcdefgh"[:i] for i in range(9)]
    counts = {w: rng.randint(1, 9) for w in base}
    counts |= {"chain" + "abcdefgh"[:i]: 2**i for i in range(9)}
    return counts | {"alone" * 40: 1, "alone" * 40 + "x": 5}


@pytest.mark.parametrize("crowd", [256, 3])
def test_variants(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    counts = vocabulary()
    df = spark.createDataFrame([(w, n, w, 0) for w, n in counts.items()], "word string, n int, other string, sig int")
    assert found(spelling.spelling_variants(df)) == plain(counts)


def test_short_words(spark):
    counts = {"a": 1, "b": 2, "ab": 4, "": 9, "abc": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").union(spark.createDataFrame([(None, 3)], "word string, n long"))
    assert found(spelling.spelling_variants(df)) == plain(counts)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_query_on_documents(spark, made, made_frame, monkeypatch):
    runs = spelling.runs(made_frame)
    got = Counter(r.word for r in queries.misspelt(runs).collect())
    want = Counter()
    for d, text in made:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{d}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    assert got == want
    counts = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert found(spelling.spelling_variants(spelling.counted(queries.misspelt(runs)))) == plain(counts)


def test_odd_documents(spark, odd_frame):
    words = spelling.counted(queries.misspelt(spelling.runs(odd_frame)))
    assert spelling.spelling_variants(words).count() == words.count() > 0
    assert spelling.runs(odd_frame.limit(0)).count() == 0
