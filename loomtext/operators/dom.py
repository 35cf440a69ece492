"""A small element tree over the standard parser, for the operators that need structure."""

from __future__ import annotations

import html
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same kind closes.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)
    parent: Element | None = None
    marks: bool = False
    blocks: bool = False

    def elements(self) -> list[Element]:
        """All elements below, in document order; no recursion, whatever the depth."""
        out, stack = [], [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            out.append(e)
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))
        return out

    def text(self) -> str:
        parts, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                parts.append(c)
            else:
                stack.extend(reversed(c.children))
        return "".join(parts)

    def markup(self) -> str:
        parts: list[str] = []
        stack: list[Element | str | tuple[str]] = [self]
        while stack:
            c = stack.pop()
            if isinstance(c, tuple):
                parts.append(c[0])
            elif isinstance(c, str):
                parts.append(html.escape(c, quote=False))
            else:
                attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in c.attrs.items())
                parts.append(f"<{c.tag}{attrs}>")
                if c.tag not in VOID:
                    stack.append((f"</{c.tag}>",))
                    stack.extend(reversed(c.children))
        return "".join(parts)

    def remove(self) -> None:
        if self.parent:
            self.parent.children.remove(self)
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root")

    def _close(self, tags: tuple[str, ...] | frozenset[str]) -> None:
        e = self.at
        while e.parent and e.tag not in tags and e.tag not in ("table", "ul", "ol", "dl", "div", "article", "section", "body"):
            e = e.parent
        if e.parent and e.tag in tags:
            self.at = e.parent

    def handle_starttag(self, tag, attrs):
        if tag in _SIBLINGS:
            self._close(_SIBLINGS[tag])
        elif tag in _CLOSES_P:
            self._close(("p",))
        e = Element(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, parent=self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e.parent and e.tag != tag:
            e = e.parent
        if e.parent:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(source: str) -> Element:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root
