"""Tag sets, tables and patterns of text extraction."""

from __future__ import annotations

import html.entities

# Tags whose content is never text.
SKIP_TAGS = (
    "head", "nav", "header", "footer", "aside", "menu", "noscript", "form", "select", "figcaption",
    "template", "svg", "textarea", "iframe", "rt", "rp",
)

# Tags that stand for a space.
BLOCK_TAGS = (
    "p", "div", "br", "wbr", "hr", "li", "ul", "ol", "td", "th", "tr", "dt", "dd",
    "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "aside", "main",
    "blockquote", "figcaption", "figure", "details", "summary", "caption", "thead", "tbody", "tfoot",
    "address", "pre", "fieldset", "legend",
)

# Tags that may hold wiki boilerplate, and the parts of a class or id that tell it.
WIKI_TAGS = ("div", "ol", "ul", "table", "span", "section")
WIKI_IDS = (
    "toc", "references", "reflist", "catlinks", "mw-panel", "mw-navigation", "sidebar", "sitesub",
    "contentsub", "jump-to-nav", "navbox", "external", "see-also", "further-reading", "mw-head",
    "mw-page-base", "mw-head-base", "footer", "printfooter",
)

# Names beyond HTML 4; those in the first group exist in lower and upper case.
_BOTH_CASES = (
    "abreve aogonek cacute ccaron dcaron dstrok ecaron eogonek gbreve lcaron lstrok nacute ncaron odblac "
    "racute rcaron sacute scedil tcaron tcedil udblac zacute zcaron zdot"
).split()
_OWN = {"Aogonek": 0x104, "aogonek": 0x105, "Eogonek": 0x118, "eogonek": 0x119, "nbsp": 0x20}


def _entities() -> dict[str, int]:
    table = dict(html.entities.name2codepoint)
    extra = _BOTH_CASES + [n.capitalize() for n in _BOTH_CASES] + ["apos", "Idot", "inodot"]
    for name in extra:
        known = html.entities.html5.get(name + ";")
        table[name] = ord(known) if known else _OWN[name]
    return table | _OWN


#: Named character references: name without ``&`` and ``;`` to code point.
ENTITIES: dict[str, int] = _entities()

#: What numeric references 0x80 to 0x9F stand for, where Windows-1252 has a character.
WINDOWS_1252: dict[int, int] = {
    n: ord(c) for n in range(0x80, 0xA0) if (c := bytes([n]).decode("cp1252", "ignore"))
}

# Patterns, written so that Java's and RE2's engines agree.

#: Unicode White_Space.
WHITE = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: Controls, DEL and invisible characters, which vanish.
DROPPED = (
    "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{AD}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}"
    "\\x{2060}\\x{2066}-\\x{2069}\\x{FE0F}\\x{FEFF}]"
)
#: Runs that become one space.
SPACES = "[ \\t\\n\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
#: The same runs but for a lone space, which may stay as it is.
CHANGED_SPACES = f"{SPACES[:-1].replace('[ ', '[', 1)}{SPACES[:-1]}*+| {SPACES[:-1]}++"
#: What only the full patterns can treat: anything but tab, line ends, printable ASCII and plain Latin-1.
UNUSUAL = "[^" + "".join(f"\\x{n:02X}" for n in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))) + "]"  # a bit set for Java
#: ``CHANGED_SPACES`` where nothing is unusual.
CHANGED_ASCII_SPACES = "[\\t\\n\\r][ \\t\\n\\r]*+| [ \\t\\n\\r]++"
#: References and the text between them.
ENTITY_TOKEN = "&[^; \\t\\n\\r<]*+;?|[^&]++"
NUMERIC = "^&#(?:[xX]\\+?[0-9a-fA-F]+|\\+?[0-9]+);$"
BARE_NAME = "^&[A-Za-z][A-Za-z0-9]+$"
#: Comments, directives, tags and text; they tile any input.
MARKUP_TOKEN = (
    "<!--(?s:.*?)(?:-->|\\z)"
    "|<![^>]*(?:>|\\z)"
    "|<[^>\\t\\n\\f\\r ]*+(?:[\\t\\n\\f\\r ](?:[^>\"']++|\"[^\"]*+(?:\"|\\z)|'[^']*+(?:'|\\z))*+)?(?:>|\\z)"
    "|[^<]++"
)
TAG_NAME = "^<([^!>\\t\\n\\f\\r ][^>\\t\\n\\f\\r ]*)"
#: Reference markers; what the group holds stays.
MARKERS = "([A-Za-z0-9]edit\\][^\\[]*)|\\[[0-9]+\\]|\\[edit\\]|\\[citation needed\\]|edit\\]"


def attribute(name: str) -> str:
    """The first ``name=`` of a tag: its value in group 1, 2 or 4; group 3 is a quote that nothing closes."""
    letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)
    return f"(?:^|[ \\t\\n\\r\"'<]){letters}=[{WHITE}]*(?:\"([^\"]*)\"|'([^']*)'|([\"'])|([^{WHITE}>]*))"

