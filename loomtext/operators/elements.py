"""Elements of pages as nested intervals of token positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import let
from ..functions.tokens import markup_tokens, tag_name, token_kind
from .wide import tag_effect

#: Tags that have no content, and so no end tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def page_tags(pages: DataFrame, html: str = "html", id_column: str = "page_id") -> DataFrame:
    """``page_id, position, token, name, size``: every tag, its token's position from 1, and the number of the page's tokens."""
    tokens = markup_tokens(html)
    split = pages.select(F.col(id_column).alias("page_id"), let(tokens, lambda ts: F.struct(ts.alias("ts"), F.size(ts).alias("size"))).alias("t"))
    rows = split.select("page_id", F.col("t.size").cast("long").alias("size"), F.posexplode("t.ts").alias("at", "token"))
    tags = rows.where(token_kind(F.col("token")) == "tag")
    return tags.select("page_id", (F.col("at") + 1).cast("long").alias("position"), "token", tag_name(F.col("token")).alias("name"), "size")


def matched(brackets: DataFrame, keys: list[str]) -> DataFrame:
    """``brackets`` that open (``step`` 1), with ``level`` and ``end``, the position of what closes them (-1), null if nothing does.

    Per key and in order of ``position`` the depth is the running sum of steps, less its
    least value so far where that is below 0: closings without an opening do nothing.
    An opening has the level it reaches, a closing the level it leaves, and on one level
    they alternate, so an opening is closed by the next row of its level.
    """
    page = Window.partitionBy(*keys).orderBy("position")
    upto = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = brackets.withColumn("_sum", F.sum("step").over(upto))
    deep = summed.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    before = F.lag("_depth", 1, 0).over(page)
    levelled = deep.withColumn("level", F.when(F.col("step") > 0, F.col("_depth")).otherwise(before)).where("level > 0")
    same = Window.partitionBy(*keys, "level").orderBy("position")
    return levelled.withColumn("end", F.lead("position").over(same)).where("step > 0").drop("_sum", "_depth")


def _with_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``depth, parent`` to elements that come page by page in order of their starts; only those still open are held."""
    page, open_ = object(), []
    for batch in batches:
        depths, parents = [], []
        for this, start, end in zip(batch["page_id"].to_pylist(), batch["start"].to_pylist(), batch["end"].to_pylist()):
            if this != page:
                page, open_ = this, []
            open_ = [x for x in open_ if x[1] > start]
            depths.append(len(open_))
            parents.append(open_[-1][0] if open_ else None)
            if end > start:
                open_.append((start, end))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(depths, pa.int64()), pa.array(parents, pa.int64())], names=[*batch.schema.names, "depth", "parent"])


def element_table(pages: DataFrame, html: str = "html", id_column: str = "page_id") -> DataFrame:
    """``page_id, name, start, end, closed, depth, parent``: one row for each start tag.

    ``start`` and ``end`` are positions of tokens (see ``page_tags``).  An end tag closes the
    last open element of its name; an element without one runs to the page's last
    token (``closed`` is false), a void one ends where it starts.  ``depth`` counts the
    elements open at its start, ``parent`` is the start of the innermost of them.  Tags
    that cross (``<b><i></b></i>``) keep their own ends, so a child may outlast its parent.

    Matching is window sums, by page, name and level; parents are found in one pass over
    each page's elements in order that holds the open ones only.  Null pages and pages
    without tags have no rows; pages of one id are read as one page of mixed tokens.
    """
    tags = page_tags(pages, html, id_column)
    closing, bare = F.startswith("name", F.lit("/")), F.regexp_replace("name", F.lit("^/|/$"), F.lit(""))
    lone = ~closing & (bare.isin(*VOID_TAGS) | F.endswith("token", F.lit("/>")))
    rows = tags.select("page_id", "position", "size", bare.alias("name"), F.when(closing, -1).when(lone, 0).otherwise(1).alias("step")).where("name <> ''")
    pairs = matched(rows.where("step <> 0"), ["page_id", "name"]).select("page_id", "name", "position", "size", "end")
    voids = rows.where("step = 0").select("page_id", "name", "position", "size", F.col("position").alias("end"))
    found = pairs.unionByName(voids).select("page_id", "name", F.col("position").alias("start"), F.coalesce("end", "size").alias("end"), F.col("end").isNotNull().alias("closed"))
    ordered = found.repartition("page_id").sortWithinPartitions("page_id", "start")
    kind = found.schema["page_id"].dataType.simpleString()
    return ordered.mapInArrow(_with_parents, f"page_id {kind}, name string, start long, end long, closed boolean, depth long, parent long")


def skip_elements(pages: DataFrame, html: str = "html", id_column: str = "page_id") -> DataFrame:
    """``page_id, name, start, end, level``: elements that stripping leaves out, matched as its skip depth counts them.

    Brackets are all tags of skipped content and wiki boilerplate alike: any of their end
    tags closes the last one open, an end tag of wiki boilerplate only while some is
    open.  A null ``end``: to the end of the page.
    """
    tags = page_tags(pages, html, id_column)
    effects = tags.select("page_id", "position", "name", tag_effect(F.col("token")).alias("e")).select("page_id", "position", "name", "e.wiki", "e.skip")
    steps = effects.where("wiki <> 0 or skip <> 0")
    page = Window.partitionBy("page_id").orderBy("position")
    upto = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = steps.withColumn("_sum", F.sum("wiki").over(upto))
    deep = summed.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    own = F.when((F.col("wiki") < 0) & (F.lag("_depth", 1, 0).over(page) == 0), 0).otherwise(F.col("wiki"))
    brackets = deep.withColumn("step", own + F.col("skip")).where("step <> 0").select("page_id", "position", "name", "step")
    return matched(brackets, ["page_id"]).select("page_id", "name", F.col("position").alias("start"), "end", F.col("level").cast("long").alias("level"))


def skip_regions(pages: DataFrame, html: str = "html", id_column: str = "page_id") -> DataFrame:
    """``page_id, start, end``: the outermost of ``skip_elements``; tokens from ``start`` to before ``end`` are not text."""
    return skip_elements(pages, html, id_column).where("level = 1").select("page_id", "start", "end")
