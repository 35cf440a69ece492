"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Letters in groups, two of which a signature leaves out: words one edit apart differ in two letters at most.
GROUPS = 4
LEFT_OUT = list(combinations(range(GROUPS), 2))
#: Letters of the Latin alphabet by frequency, dealt over the groups in turn; others go by their code point.
_BY_FREQUENCY = "etaoinshrdlucmfwypvbgkjqxz"
#: Words under one signature from which on they meet by what is left after one deletion.
CROWD = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of Latin letters.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", pattern: str = RUN) -> DataFrame:
    """``doc_id, run``: every run of letters of every whole text, A-Z lower-cased.

    Null or empty texts have none; rows without an id and repeated rows count like others.
    Empty table: no rows.  Other columns, of whatever name, are not read.
    """
    found = F.regexp_extract_all(F.translate(F.col(text_column), _UPPER, _LOWER), F.lit(pattern), F.lit(0))
    return docs.select(F.col(id_column).alias("doc_id"), F.explode(found).alias("run"))


def counted(words: DataFrame, column: str = "word", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n`` of the words of at least ``least_length`` code points and ``least_count`` rows, counted on the map side first.

    Nulls are no words.  Empty table: no rows.
    """
    long = words.select(F.col(column).alias("word")).where(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _digests(word: Column) -> Column:
    """16 bits of hash of the sorted letters of each group, in one number."""
    letters = F.array_sort(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)))

    def group(c: Column) -> Column:
        place = F.instr(F.lit(_BY_FREQUENCY), c)
        return F.pmod(F.when(place > 0, place).otherwise(F.ascii(c)), F.lit(GROUPS))

    def content(found: Column, g: int) -> Column:
        own = F.array_join(F.filter(found, lambda x: x["group"] == g)["letter"], "")
        return F.shiftleft(F.xxhash64(own).bitwiseAND(F.lit(0xFFFF)), 16 * g)

    def packed(found: Column) -> Column:
        return reduce(lambda x, y: x.bitwiseOR(y), [content(found, g) for g in range(GROUPS)])

    pairs = F.transform(letters, lambda c: F.struct(c.alias("letter"), group(c).alias("group")))
    return F.transform(F.array(pairs), packed)[0]


def _mask(left_out: tuple[int, int]) -> int:
    value = sum(0xFFFF << (16 * g) for g in range(GROUPS) if g not in left_out)
    return value - (1 << 64) if value >> 63 else value


def signatures(words: DataFrame) -> DataFrame:
    """``words`` with ``sig, cls, side, skip, digest``: the rows by which words one edit apart meet.

    A word is the binary vector of its letters' first, second, ... occurrences.  One
    edit changes at most two of its places, so of ``GROUPS`` groups of letters all but
    two agree exactly: one signature for each pair left out (``skip``).  An edit also
    leaves the first or the second half as it is (``side``), halves being those of the
    longer word (``cls`` its length); with a half in the signature anagrams do not meet.
    """
    digest, length = F.col("digest"), F.char_length("word")
    rows = []
    for longer in (0, 1):
        cls = length + longer
        head = (cls / 2).cast("int")
        for side in (0, 1):
            half = F.substring("word", F.lit(1), head) if side == 0 else F.substring("word", length - (cls - head) + 1, cls - head)
            for skip, pair in enumerate(LEFT_OUT):
                key = F.xxhash64(F.lit(skip), F.lit(side), cls, digest.bitwiseAND(F.lit(_mask(pair))), half)
                rows.append(F.struct(key.alias("sig"), cls.alias("cls"), F.lit(side).alias("side"), F.lit(skip).alias("skip")))
    keyed = words.withColumn("digest", _digests(F.col("word")))
    return keyed.select("word", "n", "digest", F.inline(F.array(*rows)))


def _joined(rows: DataFrame, key: str) -> DataFrame:
    """Pairs ``a, n_a, b, n_b`` of rows with one key that are one edit apart, each at the first signature that both have."""
    left = rows.select(key, "cls", "side", "skip", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("digest").alias("d_a"))
    right = rows.select(key, "cls", "side", "skip", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("digest").alias("d_b"))
    differ = F.col("d_a").bitwiseXOR(F.col("d_b"))
    first = F.lit(len(LEFT_OUT))
    for skip, pair in reversed(list(enumerate(LEFT_OUT))):
        first = F.when(differ.bitwiseAND(F.lit(_mask(pair))) == 0, skip).otherwise(first)
    head = (F.col("cls") / 2).cast("int")
    heads = F.substring("a", F.lit(1), head) == F.substring("b", F.lit(1), head)
    met = left.join(right, [key, "cls", "side", "skip"]).where(F.col("a") < F.col("b"))
    once = (F.greatest(F.char_length("a"), F.char_length("b")) == F.col("cls")) & (first == F.col("skip")) & ((F.col("side") == 0) | ~heads)
    return met.where(once).where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: all pairs of different words (``a`` < ``b``) one inserted, deleted or replaced code point apart, once each.

    Rows with one signature are joined and verified.  A signature of more than
    ``CROWD`` words is no meeting place: its words meet by signature and what is left of
    them without one code point, which holds every pair one edit apart, and of which
    one rest has few words.  No pair is lost or capped.  ``words (word, n)`` holds every
    word once, without nulls; it is read several times, so it should be a written table.
    """
    sized = signatures(words).withColumn("crowd", F.count("*").over(Window.partitionBy("sig", "cls", "side", "skip")))
    pairs = _joined(sized.where(F.col("crowd").between(2, CROWD)), "sig")
    crowded = sized.where(F.col("crowd") > CROWD)
    places = F.sequence(F.lit(1), F.char_length("word"))
    rests = F.transform(places, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.char_length("word"))))
    apart = crowded.withColumn("rest", F.explode(F.array_distinct(F.concat(F.array("word"), rests)))).withColumn("key", F.xxhash64("sig", "rest"))
    return pairs.unionByName(_joined(apart, "key").distinct())


def variant_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n`` of ``words (word, n)``.

    ``form`` is the near word (see ``near_pairs``) of largest ``n``, ties to the
    smallest in code-point order, if its ``n`` is at least ``ratio`` times the word's.
    """
    one = F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    two = F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    around = near_pairs(words).select(F.inline(F.array(one, two)))
    best = around.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best"))
    found = words.join(best, "word", "left")
    strong = -F.col("best.m") >= ratio * F.col("n")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form.  Forms at least double in number, so a few doublings reach the end."""
    ahead = forms.where("form is not null").select("word", F.col("form").alias("root"))
    open_rows = True
    while open_rows:
        ahead = cut(ahead, "roots")
        step = ahead.join(ahead.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        open_rows = not step.where("next is not null").isEmpty()
        if open_rows:
            ahead = step.select("word", F.coalesce("next", "root").alias("root"))
    return ahead


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words (word, n)``.

    ``root`` is where following the forms ends: the word itself if it has none.
    ``words`` holds every word once, with a count of at least 1 (see ``counted``);
    null words, which nothing is near to, are left out.  Words of one length class that
    share half of their letters in order and the rest as a multiset may be many: see
    ``near_pairs``.  Empty table: no rows.  Other columns, of whatever name, are not read.
    """
    listed = cut(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null"), "words")
    forms = cut(variant_forms(listed, ratio), "forms")
    found = forms.join(_roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
