import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


def made_documents(seed=3):
    """Prose with copies, near copies, shared passages and lines, secrets, odd white space and very long texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklmnoprstuvé", k=rng.randint(2, 9))) for _ in range(400)]

    def prose(n):
        out = []
        for i in range(n):
            w = rng.choice(vocab)
            out.append(w.capitalize() + rng.choice(["", ".", ","]) if rng.random() < 0.2 else w)
            out.append(rng.choice([" "] * 12 + ["\n", "  ", "\t"]))
        return "".join(out)

    passage, line = prose(60), "A line that many documents share, word for word."
    original, docs = prose(150), []
    for i in range(90):
        kind = i % 9
        if kind == 0:
            text = prose(rng.randint(1, 300))
        elif kind == 1:
            text = original
        elif kind == 2:
            w = original.split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        elif kind == 3:
            text = prose(80) + passage + prose(40)
        elif kind == 4:
            text = "\n".join([prose(30), line, f"  {line.upper()}\t", prose(10), line, "short"])
        elif kind == 5:
            text = prose(60) + f' api_key = "{rng.getrandbits(160):040x}" ' + "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) + prose(5)
        elif kind == 6:
            text = " ".join(rng.choices(vocab[:3], k=120))
        elif kind == 7:
            text = prose(rng.randint(0, 6)) + "###%%% " * rng.randint(0, 30)
        else:
            text = "ein 漢字 😀 ▁ x" + " " * rng.randint(1, 5) + prose(20)
        docs.append((i * 7, text))
    docs += [(2001, ""), (2002, None), (2003, " \n\t "), (2004, "x" * 300_000), (2005, "word " * 30_000), (2006, prose(20_000)), (2007, "\x00a\x00 b\n\n"), (2008, "one two three four"), (2009, "One two  three FOUR")]
    return docs


@pytest.fixture(scope="session")
def made():
    return made_documents()


@pytest.fixture(scope="session")
def made_frame(spark, made):
    """The documents in many partitions, in no order, with columns whose names clash with the operators' own."""
    rows = [(d, t, ["en", "fr", None][d % 3], f"src{d % 2}", len(t or ""), d, "x") for d, t in made]
    random.Random(1).shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, shard string"
    return spark.createDataFrame(rows, schema).repartition(7)


@pytest.fixture(scope="session")
def odd_frame(spark):
    """Nulls in every column, repeated rows and ids, and clashing names."""
    long = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua " * 3
    rows = [
        (None, "a text without an id " * 6, None, None), (None, None, None, None), (1, None, None, "s"), (1, "", "en", None), (2, long, "en", "s"), (2, long, "en", "s"),
        (2, "another text of the same id " * 5, "xx", "s"), (3, long, None, None), (-5, long + "tail", "de", "t"), (2**62, "x y z", "fr", "t"), (-(2**62), "x y z", "fr", "t"),
    ]
    return spark.createDataFrame([(*r, 1.5, 2) for r in rows], "doc_id long, text string, lang string, source string, size double, keep_gaps int")
