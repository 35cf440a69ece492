"""HTML to text: tokens, their effects, and a fold over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.attributes import attribute_text
from ..functions.cleanup import cleanup_whitespace
from ..functions.common import as_column, ascii_lower, let
from ..functions.constants import BLOCK_TAGS, SKIP_TAGS, WIKI_IDS, WIKI_TAGS
from ..functions.entities import decode_entities
from ..functions.markers import strip_ref_markers
from ..functions.tokens import markup_tokens, tag_name

#: Tokens that are folded into one piece of text; pieces are joined at the end, so
#: the work of building the text stays in proportion to its length.
CHUNK = 128
_CLOSING_WIKI = tuple("/" + t for t in WIKI_TAGS)
_CLOSING_SKIP = tuple("/" + t for t in SKIP_TAGS)
_BLOCK_FORMS = tuple(form for t in BLOCK_TAGS for form in (t, "/" + t, t + "/", "/" + t + "/"))

#: Names, ``/`` included, of all tags that change the state or emit something.
_EFFECTIVE = tuple(dict.fromkeys((*WIKI_TAGS, *_CLOSING_WIKI, *SKIP_TAGS, *_CLOSING_SKIP, *_BLOCK_FORMS, "script", "/script", "style", "/style", "img")))


@dataclass(frozen=True)
class StripOptions:
    """``strip_wiki_ref_markers``: remove ``[1]``, ``[edit]`` and ``[citation needed]``."""

    strip_wiki_ref_markers: bool = False

    @classmethod
    def wikipedia(cls) -> StripOptions:
        return cls(strip_wiki_ref_markers=True)


def _is_boilerplate(tag: Column) -> Column:
    def holds(attr: str) -> Column:
        wanted = F.array(*[F.lit(x) for x in WIKI_IDS])
        return let(ascii_lower(attribute_text(tag, attr)), lambda v: (v != "") & F.exists(wanted, lambda i: F.contains(v, i)))

    return holds("class") | holds("id")


def _after_tag(state: Column, token: Column, name: Column) -> Column:
    """State after a tag that matters.  Flags first, then wiki depth, skip depth, image text, block space."""
    opens_wiki = F.when(name.isin(*WIKI_TAGS), _is_boilerplate(token).cast("int")).otherwise(0)
    ends_wiki = F.when(name.isin(*_CLOSING_WIKI) & (state["wiki"] > 0), 1).otherwise(0)
    skip = F.when(name.isin(*SKIP_TAGS), 1).when(name.isin(*_CLOSING_SKIP), -1).otherwise(0)

    def depths(wiki: Column) -> Column:
        return F.struct(
            F.when(name == "script", True).when(name == "/script", False).otherwise(state["script"]).alias("script"),
            F.when(name == "style", True).when(name == "/style", False).otherwise(state["style"]).alias("style"),
            F.greatest(state["skip"] + wiki + skip, F.lit(0)).alias("skip"),
            (state["wiki"] + wiki).alias("wiki"),
        )

    def moved(m: Column) -> Column:
        visible = ~m["script"] & ~m["style"] & (m["skip"] == 0)
        at_gap = F.when(state["out"] == "", state["gap"]).otherwise(F.endswith(state["out"], F.lit(" ")))
        space = F.when(at_gap, F.lit("")).otherwise(F.lit(" "))
        image = let(attribute_text(token, "alt"), lambda alt: F.when(alt != "", F.concat(space, decode_entities(alt), F.lit(" "))).otherwise(""))
        emitted = F.when(name == "img", image).when(name.isin(*_BLOCK_FORMS), space).otherwise("")
        return F.struct(
            m["script"].alias("script"), m["style"].alias("style"), m["skip"].alias("skip"), m["wiki"].alias("wiki"), visible.alias("visible"),
            state["gap"].alias("gap"), F.when(visible, F.concat(state["out"], emitted)).otherwise(state["out"]).alias("out"),
        )

    return let(let(opens_wiki - ends_wiki, depths), moved)


def _step(state: Column, token: Column) -> Column:
    """State after a token; only visible text and tags that matter change it."""
    kept = ("script", "style", "skip", "wiki", "visible", "gap")
    said = F.struct(*[state[k].alias(k) for k in kept], F.concat(state["out"], decode_entities(token)).alias("out"))
    tag = let(tag_name(token), lambda name: F.when(name.isin(*_EFFECTIVE), _after_tag(state, token, name)).otherwise(state))
    return F.when(F.startswith(token, F.lit("<")), tag).when(state["visible"], said).otherwise(state)


def _start(script: Column, style: Column, skip: Column, wiki: Column, gap: Column) -> Column:
    """State before a token.  ``gap``: whether the text before is empty or ends with a space."""
    visible = ~script & ~style & (skip == 0)
    return F.struct(
        script.alias("script"), style.alias("style"), skip.alias("skip"), wiki.alias("wiki"), visible.alias("visible"), gap.alias("gap"), F.lit("").alias("out")
    )


def _folded(tokens: Column, start: Column | None = None) -> Column:
    """Visible text of tokens that begin in a state; in that of a page's beginning unless given."""
    if start is None:
        no, none = F.lit(False), F.lit(0)
        start = _start(no, no, none, none, F.lit(True))

    def over_chunk(outer: Column, first: Column) -> Column:
        def closed(s: Column) -> Column:
            gap = F.when(s["out"] == "", s["gap"]).otherwise(F.endswith(s["out"], F.lit(" ")))
            fresh = F.struct(*[s[k].alias(k) for k in ("script", "style", "skip", "wiki", "visible")], gap.alias("gap"), F.lit("").alias("out"))
            return F.struct(fresh.alias("state"), F.concat(outer["pieces"], F.array(s["out"])).alias("pieces"))

        return let(F.aggregate(F.slice(tokens, first, F.lit(CHUNK)), outer["state"], _step), closed)

    none = F.struct(start.alias("state"), F.array().cast("array<string>").alias("pieces"))
    firsts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(CHUNK))
    return F.aggregate(firsts, none, over_chunk, lambda s: F.array_join(s["pieces"], ""))


def strip_to_text(html: Column | str, options: StripOptions | None = None) -> Column:
    """Visible text of ``html``: no tags, scripts, navigation or wiki boilerplate; references decoded, white space collapsed.

    A projection of built-in expressions: no shuffle, no Python worker.  Null stays
    null; an empty string stays empty.
    """
    value = as_column(html)
    visible = F.when(F.contains(value, F.lit("<")), let(markup_tokens(value), lambda tokens: _folded(tokens))).otherwise(decode_entities(value))
    if (options or StripOptions()).strip_wiki_ref_markers:
        visible = strip_ref_markers(visible)
    return cleanup_whitespace(visible)
