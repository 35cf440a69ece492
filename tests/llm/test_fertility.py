"""Bands by language and script, and every measure against plain Python."""

import random

import brute
import numpy as np
import pytest
from prose import PROSE

from loomtext.llm import fertility
from loomtext.llm import vocabularies as v

SCRIPT = {"zh": "Han", "ja": "Kana", "ko": "Hangul", "ru": "Cyrillic", "ar": "Arabic", "he": "Hebrew", "el": "Greek", "hi": "Devanagari", "ka": "Other"}
LETTERS = {
    "zh": (0x4E00, 0x9FFF), "ja": (0x3041, 0x30FF), "ko": (0xAC00, 0xD7A3), "ru": (0x410, 0x44F), "ar": (0x621, 0x64A), "he": (0x5D0, 0x5EA),
    "el": (0x391, 0x3C9), "hi": (0x905, 0x94D),
}


def judged(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r.doc_id: r for r in fertility.quality(frame, v.PIECES, v.BYTE_RANKS, v.BYTE_PATTERN, **options).collect()}


@pytest.mark.parametrize(("lang", "script"), SCRIPT.items())
def test_dominant_script(lang, script):
    assert fertility.dominant_script(PROSE[lang]) == script


def test_prose_of_every_script_is_kept(spark):
    rows = [(3 * i + j, text, lang if j == 0 else "zz" if j == 1 else None) for i, (lang, text) in enumerate(PROSE.items()) for j in range(3)]
    got = judged(spark, rows)
    assert [rows[d] for d, r in got.items() if not r.kept] == []
    assert {r.script for r in got.values()} == set(SCRIPT.values())


def test_junk_of_every_script_is_rejected(spark):
    rng = random.Random(2)
    rows = []
    for lang, (a, b) in LETTERS.items():
        for _ in range(5):
            text = " ".join("".join(chr(rng.randint(a, b)) for _ in range(rng.randint(3, 8))) for _ in range(80))
            rows += [(len(rows), text, lang), (len(rows) + 1, text, None)]
            coded = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=12)) for _ in range(80))
            rows.append((len(rows), coded, lang))  # encoded data under the language's name
    got = judged(spark, rows)
    assert not any(r.base_failed for r in got.values())
    assert [(rows[d][2], r.script, r.chars_per_token, r.fallback_share, r.entropy) for d, r in got.items() if r.kept] == []


def test_bands_are_parameters(spark):
    rows = [(0, PROSE["ru"], "ru")]
    assert judged(spark, rows)[0].kept
    assert not judged(spark, rows, languages={"ru": fertility.Band(4.0, 8.0, 0.1, 4.0, ("Cyrillic",))})[0].kept
    assert judged(spark, rows, languages={"en": fertility.LANGUAGES["en"]})[0].kept  # by script


def test_token_measures_against_plain_python(spark, made):
    texts = [(d, t) for d, t in made if len(t or "") < 5000] + [(9000 + i, t) for i, t in enumerate(PROSE.values())]
    rows = [(d, t, ["en", "fr", None, "ru", "ja"][d % 5]) for d, t in texts]
    want = brute.fertility(rows, v.PIECES, v.BYTE_RANKS, v.BYTE_PATTERN, fertility.LANGUAGES, fertility.SCRIPTS)
    got = judged(spark, rows)
    for d, (per_token, fallback, entropy, kept) in want.items():
        r = got[d]
        assert abs(r.chars_per_token - per_token) < 1e-9 and abs(r.fallback_share - fallback) < 1e-9 and abs(r.entropy - entropy) < 1e-9, d
        assert r.kept == kept, d
    assert {kept for *_, kept in want.values()} == {True, False}


def test_long_texts_are_coded_in_parts():
    import tiktoken

    _, encoding, _ = fertility._vocabularies(v.PIECES, v.BYTE_RANKS, v.BYTE_PATTERN)
    assert isinstance(encoding, tiktoken.Encoding)
    rng = random.Random(4)
    text = "".join(rng.choice(["word", "Größe", "12", "...", "\n", "  ", "a"]) + rng.choice([" ", "", " "]) for _ in range(3000))
    for limit in (250, 333):
        some = fertility.parts(text, limit)
        assert "".join(some) == text and len(some) > 5
        assert [i for p in some for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)
    assert list(map(len, fertility.parts(" " * 120_001))) == [50_000, 50_000, 20_001]


def test_entropy_does_not_grow_with_length():
    rng = np.random.default_rng(3)
    codes = rng.zipf(1.3, 40_000) % 3000
    whole = fertility.entropies(codes, np.array([0, 40_000]))[0]
    short = fertility.entropies(codes[:256], np.array([0, 256]))[0]
    assert abs(whole - short) < 0.35
    assert fertility.entropies(np.array([1, 1, 2, 2, 7]), np.array([0, 4, 4, 5]), 4).tolist() == [1.0, 0.0, 0.0]
