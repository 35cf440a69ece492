"""Laid-out text: blocks, lists, tables and link footnotes at a line width."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats as f
from ..functions.common import as_column
from .dom import Element, parse
from .strip import strip_to_text

_HIDDEN = frozenset("head script style noscript template svg iframe title meta link".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
_SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())

_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}


def _note(root: Element) -> None:
    """Note of every element whether it holds a word (``marks``) and a block (``blocks``), from the leaves up."""
    for e in reversed([root, *root.elements()]):
        below = [c for c in e.children if isinstance(c, Element)]
        e.marks = any(c.marks for c in below) or any(isinstance(c, str) and not c.isspace() for c in e.children)
        e.blocks = any(c.blocks or c.tag in _BLOCKS for c in below)


def wrapped(words: list[str], room: int, first: str = "", rest: str = "") -> list[str]:
    """Lines of at most ``room`` characters behind their indents; a word longer than a line is broken."""
    lines: list[str] = []
    line: list[str] = []
    indent, used, width = first, 0, room - len(first)
    for word in words:
        while word:
            gap = 1 if line else 0
            if used + gap + len(word) <= width:
                line.append(word)
                used += gap + len(word)
                break
            if len(word) > width and used + gap < width:
                line.append(word[: width - used - gap])
                word = word[width - used - gap :]
            lines.append(indent + " ".join(line))
            line, indent, used, width = [], rest, 0, max(1, room - len(rest))
    return [*lines, indent + " ".join(line)] if line else lines


class _Layout:
    def __init__(self, width: int):
        self.width, self.lines, self.links = max(width, 4), [], []
        self.words: list[str] = []
        self.first = self.rest = ""

    def flush(self) -> None:
        words = "".join(self.words).split()
        self.words = []
        if words:
            self.lines += wrapped(words, max(self.width, len(self.first) + 1, len(self.rest) + 4), self.first, self.rest)
            self.first = self.rest

    def gap(self) -> None:
        if self.lines and self.lines[-1].strip():
            self.lines.append(self.rest.rstrip())

    def block(self, e: Element, first: str = "", rest: str = "") -> Iterator:
        self.flush()
        spaced = e.tag in _SPACED
        if spaced:
            self.gap()
        before = self.first, self.rest
        self.first, self.rest = self.first + first, self.rest + rest
        if e.tag == "pre":
            self.lines += [self.rest + x for x in e.text().strip("\n").split("\n")]
        elif e.tag == "table":
            self.table(e)
        else:
            yield self.inside(e)
            self.flush()
        self.first, self.rest = (before[1], before[1]) if self.first == self.rest else before
        if spaced:
            self.gap()

    def inside(self, e: Element) -> Iterator:
        """Lays out what ``e`` holds.  Yields the steps within it, which ``walk`` runs: pages nest deeper than calls may."""
        number = 0
        for c in e.children:
            if isinstance(c, str):
                self.words.append(c)
            elif c.tag in _HIDDEN:
                continue
            elif c.tag == "br":
                self.flush()
            elif c.tag == "hr":
                self.flush()
                self.lines.append(self.rest + "-" * max(3, min(self.width, 80) - len(self.rest)))
            elif c.tag == "img":
                self.words.append(f" [{c.attrs['alt']}] " if c.attrs.get("alt") else "")
            elif c.tag == "li":
                number += 1
                mark = f"{number}. " if e.tag == "ol" else "* "
                yield self.block(c, mark, " " * len(mark))
            elif c.tag == "blockquote":
                yield self.block(c, "> ", "> ")
            elif c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                yield self.block(c, "#" * int(c.tag[1]) + " ", "")
            elif c.tag == "dd":
                yield self.block(c, "  ", "  ")
            elif c.tag in _BLOCKS:
                yield self.block(c)
            elif c.tag == "a" and c.attrs.get("href"):
                self.words.append("[")
                yield self.inside(c)
                self.links.append(c.attrs["href"])
                self.words.append(f"][{len(self.links)}]")
            elif mark := _MARKS.get(c.tag):
                shown = c.marks and not c.blocks
                self.words.append(mark if shown else "")
                yield self.inside(c)
                self.words.append(mark if shown else "")
            else:
                yield self.inside(c)

    @staticmethod
    def walk(steps: Iterator) -> None:
        stack = [steps]
        while stack:
            inner = next(stack[-1], None)
            if inner is None:
                stack.pop()
            else:
                stack.append(inner)

    def table(self, e: Element) -> None:
        rows = [[" ".join(c.text().split()) for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in e.elements() if r.tag == "tr"]
        rows = [r for r in rows if r]
        columns = max(map(len, rows), default=0)
        if not columns:
            return
        widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(columns)]
        room = max(columns, self.width - 3 * (columns - 1) - len(self.rest))
        if sum(widths) > room:
            widths = [max(1, w * room // max(1, sum(widths))) for w in widths]
        for r in rows:
            cells = [wrapped(r[i].split(), max(1, widths[i])) or [""] if i < len(r) else [""] for i in range(columns)]
            for n in range(max(map(len, cells))):
                line = " | ".join((c[n] if n < len(c) else "").ljust(w) for c, w in zip(cells, widths))
                self.lines.append((self.rest + line).rstrip())


def layout(source: str, width: int) -> str:
    """Text of a page at ``width`` characters a line, links numbered and listed at the end."""
    out = _Layout(width)
    root = parse(source)
    _note(root)
    out.walk(out.inside(root))
    out.flush()
    while out.lines and not out.lines[-1].strip():
        out.lines.pop()
    notes = [f"[{i}]: {link}" for i, link in enumerate(out.links, 1)]
    return "\n".join(out.lines + ([""] if notes and out.lines else []) + notes) + ("\n" if out.lines or notes else "")


def _laid_out(width: int):
    @F.arrow_udf(T.StringType())
    def run(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            rows = []
            for page in batch.to_pylist():
                try:
                    rows.append(layout(page, width) if page is not None else None)
                except (ValueError, AssertionError):
                    rows.append(None)
            yield pa.array(rows, pa.string())

    return run


def extract_html2text(html: Column | str, width: int = 80) -> Column:
    """Result struct of the laid-out page; of the stripped page, with ``fallback``, if it cannot be parsed.

    Null stays null.
    """
    value = as_column(html)
    text = _laid_out(width)(value)
    return (
        F.when(value.isNull(), F.lit(None).cast(f.EXTRACTED))
        .when(text.isNotNull(), f.extracted(text, f.HTML, "html2text"))
        .otherwise(f.extracted(strip_to_text(value), f.HTML, "strip", fallback=True))
    )
