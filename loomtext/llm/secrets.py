"""Secret scans: base patterns, and a randomness test battery with false-discovery control.

DataFrame expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, and which matches count.  A run is matched from its start only.
BASE: tuple[tuple[str, str, Callable[[Column], Column]], ...] = (
    ("assign", ASSIGN, lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda hit: F.char_length(hit) >= 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", lambda hit: F.char_length(hit) >= 16),
)
#: Tokens that the battery looks at; a sign of equality is padding at the end only, and may stand before a token.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?"
#: Parts, between separators, of a token that is not random as a whole.
PARTS = ("[A-Za-z0-9_-]{20,}+", "[A-Za-z0-9+/]{20,}+", "[A-Za-z0-9]{20,}+")
#: Encodings in the order in which they are tried: name, pattern without padding, alphabet.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Chance that two places of a token that is no secret hold the same symbol.  hex, HEX: decimal
#: digits, one in ten.  base32: capitals, below the 0.067 of English letters.  The others: the
#: lower quartile of 3,400 identifiers and paths of 20 or more characters in the sources of
#: Python's standard library (median 0.053), so that ordinary names with many different letters
#: count as ordinary; random ones have 0.016.
ORDINARY = {"hex": 0.1, "HEX": 0.1, "base32": 0.06, "base64": 0.043, "base64url": 0.043}
#: Lengths at which a new class begins, for the false-discovery control.
LENGTHS = (20, 24, 32, 48, 96)
#: Share of ordinary tokens among the found ones, share of random tokens among those thrown out, and bins of -log10(p).
FALSE_SHARE, LOST_SHARE, BINS_PER_DECADE, BINS = 0.05, 0.01, 20, 400
_CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _sum(xs: Column, kind: str = "long") -> Column:
    return F.aggregate(xs, F.lit(0).cast(kind), lambda a, x: a + x)


def before(lengths: Column) -> Column:
    """Sum of the entries before each entry, in linear memory: sums of chunks, then within a chunk."""
    def with_sums(sums: Column) -> Column:
        return let(
            F.transform(sums, lambda _, c: _sum(F.slice(sums, F.lit(1), c))),
            lambda starts: F.transform(
                lengths,
                lambda _, i: F.get(starts, F.floor(i / _CHUNK).cast("int")) + _sum(F.slice(lengths, (F.floor(i / _CHUNK) * _CHUNK + 1).cast("int"), i % _CHUNK)),
            ),
        )

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")),
        lambda c: _sum(F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK))),
    )
    return let(chunks, with_sums)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, hit>>`` of the leftmost non-overlapping matches, in code points."""
    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
        return let(
            F.transform(hits, lambda h: F.char_length(h).cast("long")),
            lambda sizes: let(
                gaps,
                lambda g: let(
                    before(F.zip_with(sizes, F.slice(g, F.lit(1), F.size(sizes)), lambda a, b: a + b)),
                    lambda starts: F.transform(
                        hits,
                        lambda h, i: let(
                            F.get(starts, i) + F.get(g, i),
                            lambda s: F.struct(s.alias("start"), (s + F.get(sizes, i)).alias("end"), h.alias("hit")),
                        ),
                    ),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic form that is within 2e-4."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _battery(token: Column) -> Column:
    """``struct<encoding, length, p_ordinary, p_random>`` of one token, null for an unknown encoding.

    ``p_ordinary``: chance of so even a use of the alphabet if the token were ordinary
    text, whose chi-squared statistic grows with its length.  ``p_random``: the whole
    battery's chance if the token were random, that is the least of those of the
    chi-squared, runs and lag-one correlation statistics, times three (Bonferroni).
    """
    body = F.regexp_replace(token, "=+$", "")

    def measured(values: Column, k: int, ordinary: float) -> Column:
        n = F.size(values).cast("double")
        squares = _sum(F.transform(F.array_distinct(values), lambda v: let(F.size(F.filter(values, lambda x: x == v)).cast("double"), lambda c: c * c)), "double")
        half = k / 2
        highs = F.transform(values, lambda v: (v >= half).cast("int"))
        mean = _sum(F.transform(values, lambda v: v.cast("double")), "double") / n
        following = F.slice(values, F.lit(2), F.size(values) - 1)

        def tested(x2: Column, high: Column, m: Column) -> Column:
            extra = k * ordinary - 1
            z_ordinary = (x2 - ((k - 1) + n * extra)) / F.sqrt(2 * ((k - 1) + 2 * n * extra))
            degrees = k - 1
            z_even = (F.pow(F.greatest(x2, F.lit(1e-9)) / degrees, F.lit(1 / 3)) - (1 - 2 / (9 * degrees))) / (2 / (9 * degrees)) ** 0.5
            above = _sum(high).cast("double")
            below = n - above
            changes = _sum(F.transform(F.slice(high, F.lit(2), F.size(high) - 1), lambda x, i: (x != F.get(high, i)).cast("int")))
            expected = 2 * above * below / n + 1
            spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
            z_runs = F.when((above == 0) | (below == 0), F.lit(9.0)).otherwise(F.abs(changes + 1 - expected) / spread)
            products = _sum(F.transform(following, lambda v, i: (v - m) * (F.get(values, i) - m)), "double")
            variance = _sum(F.transform(values, lambda v: (v - m) * (v - m)), "double")
            z_serial = F.when(variance == 0, F.lit(9.0)).otherwise(F.abs(products / variance + 1 / n) * F.sqrt(n))
            random = 3 * F.least(_normal_tail(z_even), 2 * _normal_tail(z_runs), 2 * _normal_tail(z_serial))
            return F.struct(n.cast("int").alias("length"), _normal_tail(-z_ordinary).alias("p_ordinary"), random.alias("p_random"))

        return let(squares * k / n - n, lambda x2: let(highs, lambda h: let(mean, lambda m: tested(x2, h, m))))

    def values_of(b: Column, alphabet: str) -> Column:
        return F.transform(F.split(b, ""), lambda c: F.position(c, F.lit(alphabet)) - 1)

    def named(f: Column, name: str) -> Column:
        return F.struct(F.lit(name).alias("encoding"), f["length"].alias("length"), f["p_ordinary"].alias("p_ordinary"), f["p_random"].alias("p_random"))

    def of(b: Column) -> Column:
        chosen = F.when(F.lit(False), F.lit(None).cast("struct<encoding:string,length:int,p_ordinary:double,p_random:double>"))
        for name, pattern, alphabet in ENCODINGS:
            found = let(values_of(b, alphabet), _fixed(measured, len(alphabet), ORDINARY[name]))
            chosen = chosen.when(b.rlike(pattern), let(found, _fixed(named, name)))
        return chosen

    return let(body, of)


def _length_class(length: Column) -> Column:
    kind = F.lit(LENGTHS[0])
    for start in LENGTHS[1:]:
        kind = F.when(length >= start, F.lit(start)).otherwise(kind)
    return kind


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_DECADE), F.lit(BINS)).cast("int")


def _thresholds(tokens: DataFrame, p_bin: str, share: float) -> dict[tuple, int]:
    """Per encoding and length class the least bin that the step-up rule rejects at ``share``.

    A bin stands for its largest p.  At most classes times bins rows reach the last
    step, and one row per class the driver, whatever the number of tokens.
    """
    counted = tokens.groupBy("encoding", "class", F.col(p_bin).alias("bin")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("encoding", "class")
    upward = group.orderBy(F.col("bin").desc())
    ranked = counted.select("encoding", "class", "bin", F.sum("n").over(upward).alias("found"), F.sum("n").over(group).alias("all"))
    good = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= share * F.col("found") / F.col("all"))
    return {(r.encoding, r["class"]): r.least for r in good.groupBy("encoding", "class").agg(F.min("bin").alias("least")).collect()}


def _rejected(least: dict[tuple, int], encoding: Column, kind: Column, p_bin: Column) -> Column:
    found = F.lit(False)
    for (name, start), bin_ in least.items():
        found = found | ((encoding == name) & (kind == start) & (p_bin >= bin_))
    return found


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _fixed(make: Callable[..., Column], *rest) -> Callable[[Column], Column]:
    return lambda x: make(x, *rest)


def _on_hit(counts: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: counts(m["hit"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_spans, random_spans`` of every row.

    Spans are ``struct<start, rank, kind, end>`` in code points, end exclusive.  Base
    spans are those of ``BASE``.  To these come tokens of 20 or more characters of a
    known encoding, or parts of them between separators, that two step-up rules leave,
    each over all tokens of the table within a class of encoding and length:

    1. the battery's combined chance under randomness throws out tokens that are not
       random, at most ``LOST_SHARE`` of them wrongly, as expected;
    2. of the others, those are found whose alphabet is used more evenly than ordinary
       text uses it, at most ``FALSE_SHARE`` of them ordinary, as expected.

    Of found tokens that overlap the longest counts.  Texts are scanned once; spans and
    binned chances are written, no text is shuffled.  Null or empty text: no spans.
    Null ids, ties and repeated rows are rows like any other.  Empty table: no rows.
    Other columns, of whatever name, are not read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    span = "struct<start:bigint,rank:int,kind:string,end:bigint>"

    def as_span(m: Column, rank: int, kind: str) -> Column:
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"))

    def base_of(t: Column) -> Column:
        kinds = []
        for rank, (kind, pattern, counts) in enumerate(BASE):
            found = F.filter(matches(t, pattern), _on_hit(counts))
            kinds.append(F.transform(found, _fixed(as_span, rank, kind)))
        return F.concat(*kinds).cast(f"array<{span}>")

    def with_parts(m: Column) -> Column:
        def moved(x: Column) -> Column:
            return F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["end"]).alias("end"), x["hit"].alias("hit"))

        parts = [F.transform(matches(m["hit"], pattern), moved) for pattern in PARTS]
        return F.when(m["hit"].rlike("[+/_-]"), F.concat(F.array(m), *parts)).otherwise(F.array(m))

    def tested(m: Column) -> Column:
        return let(
            _battery(m["hit"]),
            lambda b: F.when(
                b.isNotNull(),
                F.struct(
                    m["start"].alias("start"), m["end"].alias("end"), b["encoding"].alias("encoding"), _length_class(b["length"]).alias("class"),
                    _bin(b["p_random"]).alias("random"), _bin(b["p_ordinary"]).alias("ordinary"),
                ),
            ),
        )

    def longest(found: Column) -> Column:
        """Of a token and its parts, those that overlap no longer one."""
        falling = F.reverse(F.array_sort(F.transform(found, lambda x: F.struct((x["end"] - x["start"]).alias("size"), x.alias("x")))))
        return F.aggregate(
            falling["x"],
            F.slice(found, F.lit(1), F.lit(0)),
            lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(x))),
        )

    scanned = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        base_of(text).alias("base"),
        matches(text, CANDIDATE).alias("tokens"),
    )
    # One step a projection, as the analyzer takes no deeper nesting of lambdas.
    for step in (
        F.transform("tokens", with_parts),
        F.transform("tokens", lambda some: F.filter(F.transform(some, tested), lambda x: x.isNotNull())),
    ):
        scanned = scanned.select("doc_id", "base", step.alias("tokens"))
    scanned = cut(scanned, "scanned")
    tokens = scanned.select(F.explode(F.flatten("tokens")).alias("t")).select("t.*")
    unlike = _thresholds(tokens, "random", LOST_SHARE)
    left = tokens.where(~_rejected(unlike, F.col("encoding"), F.col("class"), F.col("random")))
    apart = _thresholds(left, "ordinary", FALSE_SHARE)

    def stands_out(t: Column) -> Column:
        return ~_rejected(unlike, t["encoding"], t["class"], t["random"]) & _rejected(apart, t["encoding"], t["class"], t["ordinary"])

    scanned = scanned.select("doc_id", "base", F.transform("tokens", lambda some: F.filter(some, stands_out)).alias("tokens"))
    scanned = scanned.select("doc_id", "base", F.array_sort(F.flatten(F.transform("tokens", longest))).alias("tokens"))
    random = F.transform("tokens", _fixed(as_span, len(BASE), "random")).cast(f"array<{span}>")
    counts = [F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind, _, _ in BASE]
    return scanned.select("doc_id", *counts, F.col("base").alias("base_spans"), random.alias("random_spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Spans as in ``secret_spans``, listed as ``kind:start:end``; those of a null or empty
    text are an empty string.  Null ids, repeated rows, empty tables as there.
    """
    return secret_spans(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base_spans", "random_spans")).alias("spans"),
    )
