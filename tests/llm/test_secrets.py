"""Secrets behind names, signs of equality and paths."""

import collections
import random

import brute
import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import secrets

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_secrets_behind_names_and_paths(spark):
    rng = np.random.default_rng(12)
    frames = (
        "x AWS_SECRET_ACCESS_KEY={} y", "see https://host.example/get?user=me&sig={}&x=1", "run --access-key={} now", "PRIVATE_KEY={}== end",
        "open /srv/my-app/data_dir/{} y", "at some-long-name_of_a_place/with/{}",
    )
    plain = BASE64[:62]
    rows = []
    for i in range(240):
        frame = frames[i % len(frames)]
        value = "".join(rng.choice(list(plain if "/srv" in frame or "place" in frame else BASE64), 40))
        rows.append((i, frame.format(value), value))
    rows += [(1000 + i, "a very-long-name/of_ordinary-words/that-is-not_secret=another-ordinary-name_here", "") for i in range(20)]
    found = {r.doc_id: r.random_spans for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, value string")).collect()}
    hits = {f: 0 for f in range(len(frames))}
    for i, text, value in rows[:240]:
        at = text.index(value)
        hits[i % len(frames)] += any(s.start <= at and s.end >= at + len(value) for s in found[i])
    assert all(n > 0.75 * 40 for n in hits.values()), hits
    assert not any(found[i] for i, _, value in rows if not value)


def test_candidates_stop_at_the_sign(spark):
    text = "NAME_OF_TWENTY_LETTERS=abcdefghijklmnopqrstuvwx== and/or x=yz"
    row = spark.createDataFrame([(text,)], "t string").select(secrets.matches(F.col("t"), secrets.CANDIDATE).alias("m")).first()
    assert [m.hit for m in row.m] == ["NAME_OF_TWENTY_LETTERS", "abcdefghijklmnopqrstuvwx=="]


def test_added_spans_against_plain_python(spark, made):
    rng, alphabets = random.Random(9), ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", BASE64, BASE64[:62] + "-_"]
    rows = list(made)
    for i in range(300):
        kind, n = rng.randrange(9), rng.choice([20, 22, 30, 40, 64, 120])
        value = "".join(rng.choices(alphabets[kind % 5], k=n))
        if kind > 5:  # names, numbers, patterns
            value = ["_".join(rng.choices(["user", "account", "total", "value", "index", "path"], k=6)), str(rng.getrandbits(120)), "abcdefghij" * 4][kind - 6]
        rows.append((10_000 + i, f"{rng.choice(['', 'key=', '?a=b&sig=', 'x/', 'word '])}{value}{rng.choice(['', '==', ' tail', '=next'])}"))
    got = {r.doc_id: {(s.start, s.end) for s in r.random_spans} for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.random_spans(rows)
    assert {d: s for d, s in got.items() if s} == {d: s for d, s in want.items() if s}
    assert sum(map(len, want.values())) > 120
    names = [d for d, t in rows if d >= 10_000 and ("account" in t or "abcdefghij" * 4 in t)]
    assert collections.Counter(bool(got[d]) for d in names)[True] == 0


def test_rates_do_not_depend_on_what_stands_before(spark):
    rng = random.Random(13)
    rows = []
    for frame in ("{}", "client_key={}", "?sig={}", "/srv/data-dir/{}"):
        for _ in range(200):
            rows.append((len(rows), frame.format("".join(rng.choices(BASE64[:62], k=40))), frame))
    found = collections.Counter()
    for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, frame string")).collect():
        found[rows[r.doc_id][2]] += any(s.end - s.start >= 40 for s in r.random_spans)
    assert all(n >= 190 for n in found.values()), found
