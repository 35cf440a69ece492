"""Stripping of huge pages over many tasks: the effects of token ranges are composed, then ranges are folded side by side.

A page's tokens are dealt out in ranges.  What a range does to the state of the strip is a
small record that composes with its neighbours': flags are the last value set, and a
depth that never falls below 0 is a shift and a floor, ``f(x) = greatest(x + shift, floor)``.
Prefix windows over these records, one row a range, give each range the state it begins
in, and then all ranges are folded at once.  Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleanup import cleanup_whitespace
from ..functions.common import let
from ..functions.constants import SKIP_TAGS, WIKI_TAGS
from ..functions.markers import strip_ref_markers
from ..functions.tokens import markup_tokens, tag_name
from ..sources.shared import stored
from .strip import _EFFECTIVE, StripOptions, _folded, _is_boilerplate, _start, strip_to_text

#: Tokens of a range, and bytes from which on a page is dealt out.
RANGE, WIDE_BYTES = 4096, 1 << 20
_CLOSING_WIKI, _CLOSING_SKIP = tuple("/" + t for t in WIKI_TAGS), tuple("/" + t for t in SKIP_TAGS)


def tag_effect(token: Column) -> Column:
    """What a token does: ``script, style`` (set, or null), ``wiki`` and ``skip`` (1, -1 or 0)."""

    def effect(name: Column) -> Column:
        def flag(tag: str) -> Column:
            return F.when(name == tag, True).when(name == "/" + tag, False)

        opens = F.when(name.isin(*WIKI_TAGS), _is_boilerplate(token).cast("int")).otherwise(0)
        return F.struct(
            flag("script").alias("script"), flag("style").alias("style"), F.when(name.isin(*_CLOSING_WIKI), -1).otherwise(opens).alias("wiki"),
            F.when(name.isin(*SKIP_TAGS), 1).when(name.isin(*_CLOSING_SKIP), -1).otherwise(0).alias("skip"),
        )

    return let(tag_name(token), effect)


def _changes(tokens: Column) -> Column:
    """Effects of the tags of a range that have one, in order."""
    tags = F.filter(tokens, lambda t: F.startswith(t, F.lit("<")) & tag_name(t).isin(*_EFFECTIVE))
    found = F.transform(tags, tag_effect)
    return F.filter(found, lambda e: (e["wiki"] != 0) | (e["skip"] != 0) | e["script"].isNotNull() | e["style"].isNotNull())


def _shift_and_floor(state: Column, step: Column) -> tuple[Column, Column]:
    return (state["shift"] + step).alias("shift"), F.greatest(state["floor"] + step, F.lit(0)).alias("floor")


def _flags_and_wiki(changes: Column) -> Column:
    """``script, style`` as last set, ``shift, floor`` of the wiki depth."""
    none = F.lit(None).cast("boolean")
    start = F.struct(none.alias("script"), none.alias("style"), F.lit(0).alias("shift"), F.lit(0).alias("floor"))
    return F.aggregate(
        changes, start,
        lambda s, e: F.struct(F.coalesce(e["script"], s["script"]).alias("script"), F.coalesce(e["style"], s["style"]).alias("style"), *_shift_and_floor(s, e["wiki"])),
    )


def _skip(changes: Column, wiki: Column) -> Column:
    """``shift, floor`` of the skip depth of a range that begins at a wiki depth; a wiki tag that closes nothing has no step."""
    start = F.struct(wiki.alias("wiki"), F.lit(0).alias("shift"), F.lit(0).alias("floor"))

    def step(s: Column, e: Column) -> Column:
        own = F.when((e["wiki"] < 0) & (s["wiki"] == 0), 0).otherwise(e["wiki"])
        return F.struct((s["wiki"] + own).alias("wiki"), *_shift_and_floor(s, own + e["skip"]))

    return F.aggregate(changes, start, step, lambda s: F.struct(s["shift"], s["floor"]))


def _begun(effects: DataFrame, shift: str, floor: str, depth: str) -> DataFrame:
    """``effects`` with the depth in which each range begins.

    After ranges of shifts s and floors f the depth is their sum, or the sum of what
    follows the floor that is highest above it: sum + greatest(0, max(f - sum so far)).
    """
    page = Window.partitionBy("row").orderBy("number")
    upto = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = effects.withColumn("_sum", F.sum(shift).over(upto))
    after = F.col("_sum") + F.greatest(F.lit(0), F.max(F.col(floor) - F.col("_sum")).over(upto))
    ended = summed.withColumn("_after", after)
    return ended.withColumn(depth, F.lag("_after", 1, 0).over(page).cast("int")).drop("_sum", "_after")


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges in as many tasks as the session works in; by size they would be few, but their work is more than their bytes."""
    spark = ranges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return ranges.repartition(tasks, "row", "number")


def _ranges(pages: DataFrame, html: str, size: int) -> DataFrame:
    """``row, number, id, tokens, changes``: ranges of tokens, dealt over the tasks, written."""
    tokens = markup_tokens(html)
    cut = let(tokens, lambda ts: F.transform(F.sequence(F.lit(1), F.size(ts), F.lit(size)), lambda i: F.slice(ts, i, F.lit(size))))
    numbered = pages.select(F.monotonically_increasing_id().alias("row"), "id", html)
    dealt = _dealt(numbered.select("row", "id", F.posexplode(cut).alias("number", "tokens")))
    return stored(dealt.withColumn("changes", _changes(F.col("tokens"))), "ranges")


def strip_wide(pages: DataFrame, html: str = "html", id_column: str = "page_id", options: StripOptions | None = None, wide_bytes: int = WIDE_BYTES, size: int = RANGE) -> DataFrame:
    """``<id_column>, text``: ``strip_to_text`` of every page, pages of ``wide_bytes`` and more over many tasks.

    Smaller pages take the projection.  The tokens of the others are dealt out in ranges of
    ``size``; two windows over one narrow row a range tell where each begins (flags and
    wiki depth first, then skip depth, which depends on it), and the ranges' texts are
    joined in order.  The same text comes out at any size.  One task tokenises a page
    (by one regular expression, a small part of the work) and one joins its text.

    Null pages have a null text.  Ids may be null or repeated.  Empty table: no rows.
    """
    wiki = (options or StripOptions()).strip_wiki_ref_markers
    given = pages.select(F.col(id_column).alias("id"), F.col(html).alias("html"))
    wide = F.octet_length("html") >= max(1, wide_bytes)
    ranges = _ranges(given.where(wide), "html", size)
    first = ranges.select("row", "number", _flags_and_wiki(F.col("changes")).alias("e")).select("row", "number", "e.*")
    before = Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    flags = {f: F.coalesce(F.last(f, ignorenulls=True).over(before), F.lit(False)) for f in ("script", "style")}
    begun = _begun(first, "shift", "floor", "wiki").withColumns(flags).select("row", "number", "script", "style", "wiki")
    second = _dealt(ranges.select("row", "number", "changes")).join(_dealt(begun), ["row", "number"])
    second = second.select("row", "number", "script", "style", "wiki", _skip(F.col("changes"), F.col("wiki")).alias("e")).select("row", "number", "script", "style", "wiki", "e.*")
    states = _begun(second, "shift", "floor", "skip").select("row", "number", "script", "style", "wiki", "skip")
    known = _dealt(ranges.select("row", "number", "id", "tokens")).join(_dealt(states), ["row", "number"])

    def text(gap: bool) -> Column:
        return _folded(F.col("tokens"), _start(F.col("script"), F.col("style"), F.col("skip"), F.col("wiki"), F.lit(gap)))

    if wiki:  # a marker may lie across two ranges, so the space between them counts
        both = known.select("row", "number", "id", text(True).alias("joined"), text(False).alias("apart"))
        ends = F.when(F.col("joined") != "", F.endswith("joined", F.lit(" "))).when(F.col("apart") != "", True)
        told = both.withColumn("ends", ends).withColumn("gap", F.coalesce(F.last("ends", ignorenulls=True).over(before), F.lit(True)))
        pieces = told.select("row", "number", "id", F.when(F.col("gap"), F.col("joined")).otherwise(F.col("apart")).alias("piece"))
    else:  # runs of spaces become one
        pieces = known.select("row", "number", "id", text(False).alias("piece"))
    whole = pieces.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("number", "piece"))).alias("pieces"))
    raw = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    stripped = whole.select("id", cleanup_whitespace(strip_ref_markers(raw) if wiki else raw).alias("text"))
    small = given.where(~F.coalesce(wide, F.lit(False))).select("id", strip_to_text("html", options).alias("text"))
    return small.unionByName(stripped).withColumnRenamed("id", id_column)
