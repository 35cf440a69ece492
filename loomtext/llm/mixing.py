"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, release
from .words import cuts, give_back, slices, split_words, vocabulary_hashes

#: Topics of the default model, hashed word features, and most rounds of its fitting.
TOPICS, FEATURES, TOPIC_ROUNDS = 8, 4096, 20
#: What 1 is of a word's weight in a text: whole numbers, which add up alike in any order.
TF_UNIT = 1 << 10
#: Bits of a scaled text's length, and of the sum over all texts, at most.
LENGTH_BITS, SUM_BITS = 36, 62
#: Steps of similarity that tell texts apart when the first centres are chosen, and the similarity from which texts count as equal there.
STEPS, SAME = 1024, 1 - 1e-4
#: Words of texts that are weighed at once, so that they stay in the processor's cache; so many make a pack.
_AT_ONCE = 1 << 16
#: Bytes of words that a task holds decoded at once.
_HELD = 1 << 19
#: Share of the texts with words that a topic must have; smaller ones are left out and their rows go to the next nearest.
LEAST_TOPIC = 0.02
#: Default targets: a dimension's categories are flattened as if their shares were the observed ones to this power.
EXPONENTS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Largest relative gap to a target that ends the fitting, and most rounds of it.
TOLERANCE, ROUNDS = 1e-4, 200
#: Relative gap up to which a target counts as met.
MET = 1e-3
#: Most rounds of the fit under the bound at one budget, rounds without a smaller gap that end it, and budgets tried.
BOUND_ROUNDS, STALL, BUDGETS = 1000, 20, 14
_NONE = "(none)"
#: Weights of counts from 1 to 255; and by weight the count, 0 for larger ones.
_TF = np.append(0, np.rint(TF_UNIT * (1 + np.log(np.arange(1, 256))))).astype(np.float32)
_COUNT = np.zeros(1 << 16, np.uint8)
_COUNT[_TF[1:].astype(np.int64)] = np.arange(1, 256)
DIMENSIONS = ["source", "lang", "topic"]
_log = logging.getLogger(__name__)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and text, hashed word and count of its different words."""
    offsets, codes, vocabulary = split_words(texts, lower=True)
    buckets = (vocabulary_hashes(vocabulary) % np.uint64(FEATURES)).astype(np.int64)[codes]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    found, counts = np.unique(doc * FEATURES + buckets, return_counts=True)
    return np.diff(offsets), found // FEATURES, found % FEATURES, counts


def _binary(bounds: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """The numbers of each row as one binary value."""
    buffers = [None, pa.py_buffer((bounds * numbers.itemsize).astype(np.int32)), pa.py_buffer(numbers)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each row has, and all of them."""
    column, size = column.cast(pa.binary()), np.dtype(kind).itemsize
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    whole = np.frombuffer(column.buffers()[2], np.uint8) if at[-1] > at[0] else np.zeros(0, np.uint8)
    return np.diff(at) // size, whole[at[0] : at[-1]].view(kind)


def _counted(texts: pa.Array) -> pa.Array:
    """``n_words``, and the different hashed words of each text, in order, with their weights (1 + log of the count)."""
    out = [pa.array([], pa.struct([("n_words", pa.int64()), ("words", pa.binary()), ("tf", pa.binary())]))]
    for batch in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        n_words, doc, word, count = _features(batch["text"])
        bounds, tf = np.searchsorted(doc, np.arange(batch.num_rows + 1)), np.rint(TF_UNIT * (1 + np.log(count)))
        columns = [pa.array(n_words, pa.int64()), _binary(bounds, word.astype(np.uint16)), _binary(bounds, tf.astype(np.uint16))]
        out.append(pa.StructArray.from_arrays(columns, names=["n_words", "words", "tf"]))
    return pa.concat_arrays(out)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from cuts(whole, "words", _HELD)
    give_back()


def _weighed(words: pa.Array, tf: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with words; where the words of each begin, and the last end; the words and their weights."""
    sizes, word = _numbers(words, np.uint16)
    rows = np.flatnonzero(sizes)
    return rows, np.append(0, np.cumsum(sizes[rows])), word.astype(np.int64), _numbers(tf, np.uint16)[1]


def _runs(ends: np.ndarray) -> np.ndarray:
    """Bounds of runs of texts that have about ``_AT_ONCE`` words together."""
    return np.unique(np.append(np.searchsorted(ends[:-1], np.arange(0, ends[-1], _AT_ONCE)), len(ends) - 1))


def _scorer(tables: np.ndarray):
    """A function of ends, words and weights of texts: sums of weight times table entry ``(texts, tables)``.

    A text's sums depend on it alone.  Two tables at a time stand in one array of complex
    numbers, so that they are looked up and added up together.
    """
    n = len(tables) + len(tables) % 2
    pairs = np.zeros((FEATURES, n), np.float32)
    pairs[:, : len(tables)] = tables.T
    pairs = np.ascontiguousarray(pairs.view(np.complex64).T)
    held, twice = np.empty(_AT_ONCE + FEATURES, np.complex64), np.empty((_AT_ONCE + FEATURES, 2), np.float32)

    def score(ends: np.ndarray, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.empty((len(ends) - 1, n // 2), np.complex64)
        edges = _runs(ends)
        for low, high in zip(edges[:-1], edges[1:]):
            run, size, starts = slice(ends[low], ends[high]), ends[high] - ends[low], ends[low:high] - ends[low]
            twice[:size, 0] = twice[:size, 1] = weight[run]
            for i, table in enumerate(pairs):
                np.take(table, word[run], out=held[:size], mode="clip")
                products = held[:size].view(np.float32)
                np.multiply(products, twice[:size].ravel(), out=products)
                out[low:high, i] = np.add.reduceat(held[:size], starts)
        return out.view(np.float32)[:, : len(tables)]

    return score


_PACK = "place int, keys array<long>, sizes binary, norms binary, words binary, counts binary, large binary"


def _packs(idf: np.ndarray):
    """Packs of texts with words: their keys, numbers of different words and lengths of tf-idf; the words, in one byte their counts, and the weights of larger counts.

    ``place`` is the task that made a pack.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for batch in _parts(batches):
            rows, ends, word, tf = _weighed(batch["words"], batch["tf"])
            if len(rows):
                edges, count = _runs(ends), _COUNT[tf]
                large = np.flatnonzero(count == 0)
                raw = tf * idf[word]
                norms = np.sqrt(np.add.reduceat(raw * raw, ends[:-1]))
                columns = [pa.array(np.full(len(edges) - 1, place), pa.int32()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch["key"].take(pa.array(rows)))]
                columns += [_binary(edges, np.diff(ends).astype(np.uint16)), _binary(edges, norms), _binary(ends[edges], word.astype(np.uint16))]
                columns += [_binary(ends[edges], count), _binary(np.searchsorted(large, ends[edges]), tf[large])]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "keys", "sizes", "norms", "words", "counts", "large"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pack the keys and lengths of its texts; where the words of each begin, and the last end; the words and their weights."""
    for batch in batches:
        for keys, *columns in zip(*(batch[c] for c in ("keys", "sizes", "norms", "words", "counts", "large"))):
            sizes, norms, word, count, large = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(columns, (np.uint16, np.float64, np.uint16, np.uint8, np.uint16)))
            tf = _TF[count]
            if len(large):
                tf[count == 0] = large
            yield keys.values.to_numpy(), norms, np.append(0, np.cumsum(sizes, dtype=np.int64)), word.astype(np.int64), tf
    give_back()


def _totals(table: DataFrame, topics: int, add) -> np.ndarray:
    """``(topics, FEATURES + 1)`` whole numbers that ``add(totals, batches)`` collects from a task's batches, summed by Spark."""

    def rows(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["topic", "totals"])

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((topics, FEATURES + 1), np.int64)
        add(totals, batches)
        yield rows({t: totals[t] for t in np.flatnonzero(totals.any(axis=1)).tolist()})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for topic, part in zip(batch["topic"].to_pylist(), batch["totals"].to_pylist()):
                found[topic] = found.get(topic, 0) + np.frombuffer(part, np.int64)
        yield rows(found)

    kind = "topic int, totals binary"
    out = np.zeros((topics, FEATURES + 1), np.int64)
    for r in table.mapInArrow(collected, kind).repartition(topics, "topic").mapInArrow(summed, kind).collect():
        out[r.topic] = np.frombuffer(bytes(r.totals), np.int64)
    return out


def _seen(totals: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
    """Texts that have each word, and all texts."""
    for part in _parts(batches):
        totals[0, :FEATURES] += np.bincount(_numbers(part["words"], np.uint16)[1], minlength=FEATURES)
        totals[0, FEATURES] += part.num_rows


def _by_topic(tables: np.ndarray, length: float):
    """Sums of the texts of the largest score in each of ``tables``, as weights of words before idf for texts of ``length``; and how many there are."""

    def add(totals: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
        score = _scorer(tables)
        for keys, norms, ends, word, tf in _texts(batches):
            scaled = tf * np.repeat(np.rint(length / norms), np.diff(ends))
            if len(tables) > 1:
                topic = np.argmax(score(ends, word, tf), axis=1)
                word += np.repeat(topic * FEATURES, np.diff(ends))
                totals[:, FEATURES] += np.bincount(topic, minlength=len(tables))
            else:
                totals[:, FEATURES] += len(keys)
            totals[:, :FEATURES] += np.bincount(word, scaled, len(tables) * FEATURES).astype(np.int64).reshape(-1, FEATURES)

    return add


def _nearness(texts: DataFrame, idf: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By step of similarity to the nearest of ``centres``: how many texts there are, and the least key of one.

    The last step, ``STEPS``, has the texts that equal a centre.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least = np.zeros(STEPS + 1, np.int64), np.full(STEPS + 1, np.iinfo(np.int64).max)
        score = _scorer(centres * idf)
        for keys, norms, ends, word, tf in _texts(batches):
            near = score(ends, word, tf).max(axis=1) / norms
            step = np.where(near >= SAME, STEPS, np.minimum(near * STEPS, STEPS - 1)).astype(np.int64)
            n += np.bincount(step, minlength=STEPS + 1)
            np.minimum.at(least, step, keys)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n[found]), pa.array(least[found])], names=["step", "n", "key"])

    n, least = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
    for r in texts.mapInArrow(run, "step int, n long, key long").groupBy("step").agg(F.sum("n").alias("n"), F.min("key").alias("key")).collect():
        n[r.step], least[r.step] = r.n, r.key
    return n, least


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _text_of(texts: DataFrame, idf: np.ndarray, key: int) -> np.ndarray:
    """The tf-idf of a key's text over all features; only the packs of the tasks that have it are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for keys, _, ends, word, tf in _texts(batches):
            for i in np.flatnonzero(keys == key):
                one = slice(ends[i], ends[i + 1])
                found = word[one].astype(np.uint16).tobytes(), tf[one].tobytes()
                least = found if least is None else min(least, found)
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in least], names=["words", "tf"])

    mine = F.array_contains("keys", F.lit(key).cast("long"))
    places = [r.place for r in texts.where(mine).select("place").distinct().collect()]
    (row,) = texts.where(F.col("place").isin(places) & mine).mapInArrow(run, "words binary, tf binary").orderBy("words", "tf").limit(1).collect()
    out = np.zeros(FEATURES)
    out[np.frombuffer(bytes(row.words), np.uint16)] = np.frombuffer(bytes(row.tf), np.float32)
    return out * idf


def _first_centres(texts: DataFrame, idf: np.ndarray, length: float, topics: int) -> np.ndarray:
    mean = _totals(texts, 1, _by_topic(np.zeros((1, FEATURES)), length))[:, :FEATURES] * idf
    n, least = _nearness(texts, idf, _unit(mean))
    centres = [_text_of(texts, idf, int(least[np.flatnonzero(n)[-1]]))]
    while len(centres) < topics:
        n, least = _nearness(texts, idf, _unit(np.stack(centres)))
        tenth = int(np.searchsorted(np.cumsum(n), n.sum() // 10, "right"))
        step = tenth if tenth < STEPS else int(np.flatnonzero(n)[0])
        if step == STEPS:
            break
        centres.append(_text_of(texts, idf, int(least[step])))
    return _unit(np.stack(centres))


def _fit(counted: DataFrame, topics: int = TOPICS) -> np.ndarray:
    totals = _totals(counted.select("words"), 1, _seen)[0]
    if not totals[:FEATURES].any():
        return np.zeros((1, FEATURES))
    idf = np.log((1 + totals[FEATURES]) / (1 + totals[:FEATURES])) + 1
    length = 2.0 ** min(LENGTH_BITS, SUM_BITS - int(totals[FEATURES]).bit_length())
    texts = cut(counted.select("key", "words", "tf").mapInArrow(_packs(idf), _PACK), "packs")
    centres = _first_centres(texts, idf, length, topics)
    for left in reversed(range(TOPIC_ROUNDS + 1)):
        sums = _totals(texts, len(centres), _by_topic(centres * idf, length))
        sizes = sums[:, FEATURES]
        moved = _unit(np.where(sizes[:, None] > 0, sums[:, :FEATURES] * idf, centres))
        if not left or np.array_equal(moved, centres):
            break
        centres = moved
    release(texts)
    return centres[(sizes >= LEAST_TOPIC * sizes.sum()) | (sizes == sizes.max())] * idf


def _with_counts(docs: DataFrame, text: str, kept: list[str], features: bool = True) -> DataFrame:
    """The columns ``kept`` with ``key, n_words, words, tf`` of the text, written: each text is split once.

    Without ``features`` neither ``words`` nor ``tf``.
    """
    counted = F.arrow_udf(_counted, "n_words long, words binary, tf binary")(F.col(text).cast("string"))
    return cut(docs.select(*kept, F.xxhash64(text).alias("key"), counted.alias("counted")).select(*kept, "key", "counted.*" if features else "counted.n_words"), "counted")


def fit_topics(docs: DataFrame, text_column: str = "text", topics: int = TOPICS) -> np.ndarray:
    """Weights ``(topics, FEATURES)`` of spherical k-means over the tf-idf rows of all texts; a text's topic has the largest sum of them.

    Every text counts, in the document frequencies, the first centres and each round.
    The words of each text are hashed and counted once and written, and again in packs
    of texts, with the length of their tf-idf; every round is one pass over that table, whose sums are added up by
    topic before the driver sees them, at a model's size.  The first centre is a text as near to the mean as any,
    each next one is farther from those before than nine in ten texts, so that
    lone texts do not become topics (by steps of similarity of 1 in ``STEPS``; in a step the least hash).
    Rounds end when nothing moves, after ``TOPIC_ROUNDS`` at the latest.

    Sums over texts are of whole numbers: neither partitions nor the order of rows change the
    model.  Fewer different texts than topics, or groups under ``LEAST_TOPIC``: fewer
    topics.  A null or empty text has no words and counts in the document
    frequencies only, repeated rows count each.  Without any word: one topic without
    weights.  Other columns, of whatever name, are not read.
    """
    return _fit(_with_counts(docs.select(F.col(text_column).alias("text")), "text", []), topics)


def _topic_of(weights: np.ndarray):
    """The topic of each text with the given words."""

    names = pa.array([f"t{t}" for t in range(len(weights))])

    def run(words: pa.Array, tf: pa.Array) -> pa.Array:
        topics, score = [names[:0]], _scorer(weights)
        for part in _parts([pa.RecordBatch.from_arrays([words, tf], names=["words", "tf"])]):
            rows, ends, word, weight = _weighed(part["words"], part["tf"])
            topic = np.zeros(part.num_rows, np.int64)
            topic[rows] = np.argmax(score(ends, word, weight), axis=1)
            topics.append(names.take(pa.array(topic)))
        return pa.concat_arrays(topics)

    return F.arrow_udf(run, "string")("words", "tf")


def goals_of(tokens: np.ndarray, codes: list[np.ndarray], names: list[list[str]], dimensions: list[str], targets: dict[str, dict[str, float]] | None) -> list[np.ndarray]:
    """Shares that each dimension's values shall have: the given ones among values with tokens, or flattened ones.

    Flattened shares are those of the cells' tokens times, for each dimension without
    given ones, its value's share to the power ``EXPONENTS`` less 1.  As they come from one
    table over the cells that occur, they can be met together, however the
    dimensions depend on each other (topics on languages, say).
    """
    sums = [np.bincount(c, tokens, len(n)) for c, n in zip(codes, names)]
    joint, given = tokens / max(tokens.sum(), 1e-300), [(targets or {}).get(d) for d in dimensions]
    for d, code, mine, asked in zip(dimensions, codes, sums, given):
        if asked is None:
            joint = joint * (np.maximum(mine, 1e-300) / max(tokens.sum(), 1e-300))[code] ** (EXPONENTS[d] - 1)
    goals = []
    for code, mine, listed, asked in zip(codes, sums, names, given):
        raw = np.bincount(code, joint, len(listed)) if asked is None else np.array([float(asked.get(n, 0.0)) for n in listed]) * (mine > 0)
        goals.append(raw / raw.sum() if raw.sum() > 0 else raw)
    return goals


def rake(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Factors per token with which every marginal meets its goal, and the largest relative gap left."""
    weight, total, gap = np.ones(len(tokens)), tokens.sum(), 0.0
    for _ in range(ROUNDS if total > 0 else 0):
        for code, goal in zip(codes, goals):
            have = np.bincount(code, tokens * weight, len(goal))
            weight = weight * np.where(have > 0, goal * total / np.where(have > 0, have, 1.0), 0.0)[code]
        have = [np.bincount(c, tokens * weight, len(g)) / total for c, g in zip(codes, goals)]
        gap = max(np.abs(h[g > 0] / g[g > 0] - 1).max(initial=0.0) for h, g in zip(have, goals))
        if gap <= TOLERANCE:
            break
    return weight, float(gap)


def _scale_under_bound(rate: np.ndarray, tokens: np.ndarray, code: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``rate`` times a factor for each value of ``code``, so that its sum of tokens * least(1, rate) is ``wanted``.

    That sum is the least, over all cells in falling order of rate, of the tokens
    before the cell plus the factor times the sum from the cell on; the factor is
    the largest that one of these lines asks for.
    """
    order = np.lexsort((-rate, code))
    c, t, tr = code[order], tokens[order], (tokens * rate)[order]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    sizes = np.diff(np.append(starts, len(c)))
    full, spent = np.cumsum(t) - t, np.cumsum(tr) - tr
    full -= np.repeat(full[starts], sizes)
    whole = np.repeat(np.add.reduceat(tr, starts), sizes)
    rest = whole - (spent - np.repeat(spent[starts], sizes))
    supply = np.bincount(code, np.where(rate > 0, tokens, 0.0), len(wanted))
    asked = np.where(rest > 1e-9 * whole, (np.minimum(wanted, supply)[c] - full) / np.where(rest > 0, rest, 1.0), 0.0)
    return rate * np.maximum.reduceat(asked, starts)[np.searchsorted(c[starts], code)]


def fit_under_bound(
    tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], start: np.ndarray, keep_share: float, least_share: float
) -> tuple[np.ndarray, float]:
    """Probabilities of the cells with which every marginal meets its goal, and the share of all tokens they draw.

    Alternates over the dimensions, each scaled under the bound of 1.  If the goals
    cannot be met at ``keep_share``, the share is lowered to the largest at which
    they can (by bisection), but not below ``least_share``: values too rare for that
    are taken whole, and the others of their dimension share what is left.  Goals count
    as met within ``MET``; if no share tried meets them, the one that comes nearest is taken.
    """
    total = tokens.sum()
    if total <= 0 or keep_share <= 0:
        return np.minimum(1.0, start), keep_share
    supplies = [np.bincount(c, tokens, len(g)) / total for c, g in zip(codes, goals)]
    least_share = min(max(least_share, 1e-9), keep_share)

    def split(goal: np.ndarray, supply: np.ndarray, share: float, rare: np.ndarray) -> np.ndarray:
        left = max(1 - supply[rare].sum() / share, 0.0)
        others = goal[~rare].sum()
        return np.where(rare, supply / share, goal * (left / others if others > 0 else 0.0))

    rares = []
    for goal, supply in zip(goals, supplies):
        rare = np.zeros(len(goal), bool)
        while (more := ~rare & (split(goal, supply, least_share, rare) * least_share > supply * (1 + TOLERANCE))).any():
            rare |= more
        rares.append(rare)

    def attempt(share: float) -> tuple[np.ndarray, float]:
        """The probabilities that came nearest to the goals, and their gap."""
        wanted = [split(g, s, share, r) for g, s, r in zip(goals, supplies, rares)]
        rate, gaps, best = start * (share / keep_share), [], None
        for _ in range(BOUND_ROUNDS):
            chance = np.minimum(1.0, rate)
            drawn = tokens * chance / (total * share)
            gaps.append(max(np.abs(np.bincount(c, drawn, len(w))[w > 0] / w[w > 0] - 1).max(initial=0.0) for c, w in zip(codes, wanted)))
            if gaps[-1] <= min(gaps):
                best = chance
            if gaps[-1] <= TOLERANCE or (len(gaps) > 2 * STALL and min(gaps[-STALL:]) >= min(gaps[:-STALL])):
                break
            for c, w in zip(codes, wanted):
                rate = _scale_under_bound(rate, tokens, c, w * (total * share))
        return best, min(gaps)

    tried = {keep_share: attempt(keep_share)}
    if tried[keep_share][1] > MET:
        low, high = least_share, keep_share
        tried[low] = attempt(low)
        for _ in range(BUDGETS if tried[low][1] <= MET else 0):
            share = (low + high) / 2 if 4 * low > high else (low * high) ** 0.5
            tried[share] = attempt(share)
            low, high = (share, high) if tried[share][1] <= MET else (low, share)
    met = [share for share, (_, gap) in tried.items() if gap <= MET]
    share = max(met) if met else min(tried, key=lambda x: tried[x][1])
    return tried[share][0], share


def settle(cells: DataFrame, dimensions: list[str], targets: dict[str, dict[str, float]] | None, keep_share: float, least_share: float) -> DataFrame:
    """The cells with ``goal_<dimension>``, ``weight``, ``chance`` and ``budget``, written.

    All cells are raked together, in one task: the table has a row for each combination
    of categories that occurs, not for each document.
    """
    types = dict(cells.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        tokens = np.nan_to_num(table["tokens"].to_numpy().astype(np.float64))
        coded = [table[d].combine_chunks().dictionary_encode() for d in dimensions]
        codes = [c.indices.to_numpy(zero_copy_only=False) for c in coded]
        goals = goals_of(tokens, codes, [c.dictionary.to_pylist() for c in coded], dimensions, targets)
        for d, code, goal in zip(dimensions, codes, goals):
            table = table.append_column(f"goal_{d}", pa.array(goal[code]))
        weight, gap = rake(tokens, codes, goals)
        if gap > TOLERANCE:
            _log.warning("mixing: raking ended with a gap of %.3g", gap)
        everything = np.zeros(len(tokens), np.int64)
        start = _scale_under_bound(weight, tokens, everything, np.array([keep_share * tokens.sum()]))
        chance, share = fit_under_bound(tokens, codes, goals, start, keep_share, least_share)
        for name, column in (("weight", weight), ("chance", chance), ("budget", np.full(len(chance), share))):
            table = table.append_column(name, pa.array(column))
        yield from table.to_batches(max_chunksize=100_000)

    out = [*[f"{n} {types[n]}" for n in (*dimensions, "tokens")], *[f"goal_{d} double" for d in dimensions], "weight double", "chance double", "budget double"]
    return cut(cells.select(*dimensions, "tokens").coalesce(1).mapInArrow(run, ", ".join(out)), "chances")


def _marginals(chances: DataFrame, dimensions: list[str], targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """``dimension, value, target, expected, budget, met`` of every category, and of given ones that no row has."""
    drawn = F.sum(F.col("tokens") * F.col("chance"))
    rows = None
    for d in dimensions:
        sums = chances.groupBy(d).agg(F.first(f"goal_{d}").alias("target"), drawn.alias("drawn"), F.first("budget").alias("budget"))
        share = F.coalesce(F.try_divide("drawn", F.sum("drawn").over(Window.partitionBy())), F.lit(0.0))
        some = sums.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.coalesce("target", F.lit(0.0)).alias("target"), share.alias("expected"), "budget")
        rows = some if rows is None else rows.unionByName(some)
    given = [(d, v, float(x) / sum(targets[d].values())) for d in dimensions if (targets or {}).get(d) for v, x in targets[d].items() if x > 0]
    if given:
        absent = chances.sparkSession.createDataFrame(given, "dimension string, value string, target double").join(rows, ["dimension", "value"], "left_anti")
        rows = rows.unionByName(absent.withColumns({"expected": F.lit(0.0), "budget": F.lit(None).cast("double")}))
    return rows.withColumn("met", F.abs(F.col("expected") - F.col("target")) <= MET * F.col("target"))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)


def mix_to_targets(
    docs: DataFrame,
    keep_share: float = 0.8,
    targets: dict[str, dict[str, float]] | None = None,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    topic_column: str | None = None,
    least_share: float | None = None,
) -> DataFrame:
    """``docs`` with a struct ``mix``: ``topic, n_tokens, weight, probability, kept``.

    Token weights of the cells source x language x topic are raked until the three
    marginals meet their targets (``targets[dimension][value]``; by default
    flattened shares, see ``goals_of``).  As no document is drawn twice, the
    raking goes on under the bound of 1 (``fit_under_bound``) until the expected
    tokens, tokens * probability, meet the targets.  They are ``keep_share`` of all,
    or the largest share below it at which the targets can be met, but at least
    ``least_share`` (half of ``keep_share`` if not given): categories too rare for
    that are taken whole, and targets of categories without tokens fall to the others.  ``target_report`` lists what is met; a lower share and
    targets that are missed are logged.  The draw depends on seed, id and text only.

    Tokens are words.  Without ``topic_column`` a text's topic is that of a model that is
    fitted here, on all texts (``fit_topics``: tf-idf, spherical k-means); every document
    is assigned by its whole text.  A text without words has the first topic.

    ``docs`` is read once and written, with the counted words of its texts; they are not
    shuffled if the table of cells is small enough for Spark to broadcast it, which
    Spark decides by its size.

    Null source, language or topic, or no such column: a category of its own.  Null
    or empty text: no tokens; it is drawn like its cell.  Null ids are drawn by text.
    Equal rows share a draw.  Empty table: no rows.  A column ``mix`` is replaced.
    """
    return _mixed(docs, keep_share, targets, seed, id_column, text_column, topic_column, least_share)[0]


def drawn_to_targets(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``mix_to_targets`` draws, with all their columns, a column ``mix`` of their own too."""
    names = [f"_of_{i}" if c == "mix" else c for i, c in enumerate(docs.columns)]
    kept = mix_to_targets(docs.toDF(*names), **options).where("mix.kept")
    return kept.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)])


def target_report(docs: DataFrame, **options) -> DataFrame:
    """``dimension, value, target, expected, achieved, budget, met`` of the draw of ``mix_to_targets``.

    Shares of drawn tokens: as aimed at, as the probabilities have it, and as drawn.
    ``budget`` is the share of all tokens that is drawn.  Categories that targets name
    and no row has are listed as not met.  Empty table: only such ones.
    """
    mixed, settled = _mixed(docs, with_text=False, **options)
    kept = mixed.where("mix.kept").select(*[_category(docs, d).alias(d) for d in ("source", "lang")], F.col("mix.topic").alias("topic"), F.col("mix.n_tokens").alias("n"))
    kept = cut(kept.groupBy(*DIMENSIONS).agg(F.sum("n").alias("n")), "drawn")
    drawn = None
    for d in DIMENSIONS:
        some = kept.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("n").alias("n"))
        some = some.select("dimension", "value", F.try_divide("n", F.sum("n").over(Window.partitionBy())).alias("achieved"))
        drawn = some if drawn is None else drawn.unionByName(some)
    found = _marginals(settled, DIMENSIONS, options.get("targets")).join(drawn, ["dimension", "value"], "left")
    return found.select("dimension", "value", "target", "expected", F.coalesce("achieved", F.lit(0.0)).alias("achieved"), "budget", "met")


def _category(docs: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(_NONE)) if name in docs.columns else F.lit(_NONE)


def _mixed(
    docs, keep_share=0.8, targets=None, seed=0, id_column="doc_id", text_column="text", topic_column=None, least_share=None, with_text=True
) -> tuple[DataFrame, DataFrame]:
    """The rows with ``mix``, and the settled cells; without ``with_text`` only the columns that decide something are kept."""
    deciding = [id_column, "source", "lang", topic_column]
    plain = docs.select(*[c for c in docs.columns if c != "mix"])
    columns = [c for c in plain.columns if with_text or c in deciding]
    place = {c: f"c{i}" for i, c in enumerate(plain.columns)}
    plain = plain.toDF(*place.values())
    dimensions = DIMENSIONS

    def category(name: str) -> Column:
        return F.coalesce(F.col(place[name]).cast("string"), F.lit(_NONE)) if name in place else F.lit(_NONE)

    counted = _with_counts(plain, place[text_column], [place[c] for c in columns], features=not topic_column)
    topic = category(topic_column) if topic_column else _topic_of(_fit(counted))
    rows = counted.withColumns({"source": category("source"), "lang": category("lang"), "topic": topic})
    cells = cut(rows.groupBy(*dimensions).agg(F.sum("n_words").alias("tokens")), "cells")
    settled = settle(cells, dimensions, targets, keep_share, keep_share / 2 if least_share is None else least_share)
    for r in _marginals(settled, dimensions, targets).where(~F.col("met")).orderBy("dimension", "value").limit(20).collect():
        _log.warning("mixing: %s %s has target %.4g and expects %.4g", r.dimension, r.value, r.target, r.expected)
    if (used := settled.agg(F.min("budget")).first()[0]) is not None and used < keep_share:
        _log.warning("mixing: the targets are met with %.4f of the tokens, not %.4f", used, keep_share)
    chances = settled.select(*dimensions, "weight", "chance")
    drawn = uniform(F.lit(seed), F.col(place[id_column]).cast("long"), F.col("key"))
    chance = F.coalesce(F.col("chance"), F.lit(0.0))
    mix = F.struct(
        "topic", F.col("n_words").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), chance.alias("probability"), (drawn < chance).alias("kept")
    )
    joined = rows.join(chances, dimensions, "left")
    return joined.select(*[F.col(place[c]).alias(c) for c in columns], mix.alias("mix")), settled


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, kept`` of every row, as ``mix_to_targets`` has them.

    A null source or language is a category of its own.  Null or empty text: no tokens.
    Null ids and repeated rows are rows like any other.  Empty table: no rows.  Columns
    other than ``doc_id, text, source, lang`` are not read.
    """
    return _mixed(docs.select("doc_id", "text", "source", "lang"), with_text=False, **options)[0].select("doc_id", "source", "lang", "mix.*")
