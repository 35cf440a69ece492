"""DuckDB SQL for the catalogue's queries.

Lists of names (tags, ids, extensions) are shared with the operators; logic, patterns and
character tables are not: they are written anew for RE2 or made from Unicode and HTML 5
data.  Stripping is written as window functions over numbered tokens: flags are the
last value set, and a depth that never falls below 0 is a prefix sum less its least
value so far.
"""

from __future__ import annotations

import html.entities

from ..functions import constants as k
from ..functions import detect, formats
from ..operators import extract, qa
from . import cases


def _class(points: list[int], but: bool = False) -> str:
    return "[" + "^" * but + "".join(f"\\x{{{p:X}}}" for p in points) + "]"


#: All white space of Unicode; what of it makes a run (vertical tab and form feed vanish); what vanishes.
SPACE_POINTS = [p for p in range(0x3001) if chr(p).isspace() and not 0x1C <= p <= 0x1F]
RUN = _class([p for p in SPACE_POINTS if p not in (0x0B, 0x0C)]) + "+"
VANISHING = _class(
    [*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F, 0xAD, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, *range(0x2066, 0x206A), 0xFE0F, 0xFEFF]
)
TOKEN = r"""<!--(?s:.*?)(?:-->|\z)|<![^>]*(?:>|\z)|<[^>\s]*(?:\s(?:[^>"']|"[^"]*(?:"|\z)|'[^']*(?:'|\z))*)?(?:>|\z)|[^<]+"""
REFERENCE = r"&[^;<\x09\x0A\x0D\x20]*;?|[^&]+"
NUMBER = r"^&#(?:[+]?\d+|[xX][+]?[[:xdigit:]]+);$"
WORD = r"^&[[:alpha:]][[:alnum:]]+$"
MARKER = r"([[:alnum:]]edit\][^\[]*)|\[(?:\d+|edit|citation needed)\]|edit\]"
#: HTML 5 names, but for HTML 4's angle brackets, a plain space for nbsp and four names of other standards.
NAMED = {n: html.entities.html5.get(f"{n};") for n in k.ENTITIES} | {
    "lang": chr(0x2329), "rang": chr(0x232A), "nbsp": " ", "Aogonek": "Ą", "aogonek": "ą", "Eogonek": "Ę", "eogonek": "ę",
}
#: Windows-1252 from 128 to 159, where it has a character.
LEGACY = dict(zip([n for n in range(128, 160) if n not in (129, 141, 143, 144, 157)], "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"))


def attribute(name: str) -> str:
    letters = "".join(f"({c}|{c.upper()})" for c in name).replace("(", "(?:")
    space = _class(SPACE_POINTS)
    return rf"""(?:^|[\n\r\t "'<]){letters}={space}*(?:"([^"]*)"|'([^']*)'|(["'])|({_class([*SPACE_POINTS, ord('>')], True)}*))"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def table(values: tuple[str, ...], column: str) -> str:
    rows = ", ".join(f"({i}, {lit(v)})" for i, v in enumerate(values))
    return f"(SELECT * FROM (VALUES {rows}) AS v(case_id, {column}))"


def cleanup(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {lit(VANISHING)}, '', 'g'), {lit(RUN)}, ' ', 'g'), ' ')"


def markers(x: str) -> str:
    return f"regexp_replace({x}, {lit(MARKER)}, '\\1', 'g')"


def attribute_text(x: str, name: str) -> str:
    return "(" + " || ".join(f"regexp_extract({x}, {lit(attribute(name))}, {i})" for i in (1, 2, 4)) + ")"


def lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decode(x: str) -> str:
    named = "MAP {" + ", ".join(f"{lit(f'&{n};')}: {lit(p)}" for n, p in sorted(NAMED.items())) + "}"
    legacy = "MAP {" + ", ".join(f"{n}: {lit(c)}" for n, c in LEGACY.items()) + "}"
    number = (
        f"CASE WHEN regexp_matches(t, {lit(NUMBER)}) THEN CASE WHEN regexp_matches(t, '^&#[xX]')"
        " THEN try_cast('0x' || regexp_extract(t, '^&#[xX]\\+?0*([0-9a-fA-F]*);$', 1) AS UBIGINT)"
        " ELSE try_cast(regexp_extract(t, '^&#\\+?([0-9]*);$', 1) AS UBIGINT) END END"
    )
    zero = f"regexp_matches(t, '^&#[xX]?\\+?0+;$')"
    char = (
        f"CASE WHEN {zero} THEN chr(65533) WHEN ({number}) > 4294967295 THEN NULL"
        f" WHEN ({number}) > 1114111 OR ({number}) BETWEEN 55296 AND 57343 THEN chr(65533)"
        f" WHEN ({number}) BETWEEN 128 AND 159 THEN coalesce({legacy}[({number})::INTEGER], chr(65533))"
        f" WHEN ({number}) IS NOT NULL THEN chr(({number})::INTEGER) END"
    )
    bare = f"CASE WHEN regexp_matches(t, {lit(WORD)}) THEN {named}[t || ';'] END"
    one = (
        f"CASE WHEN t[1] <> '&' THEN t WHEN right(t, 1) = ';' THEN coalesce({named}[t], {char}, t)"
        f" ELSE coalesce({bare}, t) END"
    )
    return f"array_to_string(list_transform(regexp_extract_all({x}, {lit(REFERENCE)}), lambda t: {one}), '')"


def tokens_cte(source: str) -> str:
    """``source``: a query of ``id, x``."""
    return f"""src AS ({source}),
split AS (SELECT id, regexp_extract_all(x, {lit(TOKEN)}) AS ts FROM src),
tok AS (SELECT id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM split),
named AS (SELECT *, CASE WHEN t[1] <> '<' THEN 'text' WHEN starts_with(t, '<!--') THEN 'comment'
  WHEN starts_with(t, '<!') THEN 'directive' ELSE 'tag' END AS kind FROM tok),
tags AS (SELECT *, CASE WHEN kind = 'tag' THEN {lower("regexp_extract(t, '^<([^!>\\s][^>\\s]*)', 1)")} ELSE '' END AS name FROM named)"""


def strip_cte(source: str, wiki: bool = False) -> str:
    """Adds ``stripped (id, text)`` for every row of ``source``."""
    closing_wiki, closing_skip = tuple("/" + x for x in k.WIKI_TAGS), tuple("/" + x for x in k.SKIP_TAGS)
    wiki_ids = "[" + ", ".join(map(lit, k.WIKI_IDS)) + "]"
    boiler = " OR ".join(f"len(list_filter({wiki_ids}, lambda w: contains({lower(attribute_text('t', a))}, w))) > 0" for a in ("class", "id"))
    out = "coalesce(string_agg(piece, '' ORDER BY i), '')"
    return f"""{tokens_cte(source)},
steps AS (SELECT *,
  coalesce(last_value(CASE name WHEN 'script' THEN 1 WHEN '/script' THEN 0 END IGNORE NULLS) OVER w, 0) AS in_script,
  coalesce(last_value(CASE name WHEN 'style' THEN 1 WHEN '/style' THEN 0 END IGNORE NULLS) OVER w, 0) AS in_style,
  CASE WHEN name IN {names(k.WIKI_TAGS)} THEN ({boiler})::INT ELSE 0 END AS opens_wiki,
  (name IN {names(closing_wiki)})::INT AS closes_wiki,
  CASE WHEN name IN {names(k.SKIP_TAGS)} THEN 1 WHEN name IN {names(closing_skip)} THEN -1 ELSE 0 END AS skip_step
  FROM tags WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
wiki1 AS (SELECT *, sum(opens_wiki - closes_wiki) OVER w AS p FROM steps WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
wiki2 AS (SELECT *, p - least(0, min(p) OVER w) AS depth FROM wiki1 WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
wiki3 AS (SELECT *, opens_wiki + skip_step - CASE WHEN closes_wiki = 1 AND coalesce(lag(depth) OVER w, 0) > 0 THEN 1 ELSE 0 END AS step
  FROM wiki2 WINDOW w AS (PARTITION BY id ORDER BY i)),
skip1 AS (SELECT *, sum(step) OVER w AS q FROM wiki3 WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
skip2 AS (SELECT *, q - least(0, min(q) OVER w) AS skipped FROM skip1 WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
pieces AS (SELECT id, i, CASE WHEN in_script = 1 OR in_style = 1 OR skipped > 0 THEN ''
  WHEN kind = 'text' THEN CASE WHEN contains(t, '&') THEN {decode('t')} ELSE t END
  WHEN name = 'img' AND {attribute_text('t', 'alt')} <> '' THEN ' ' || {decode(attribute_text('t', 'alt'))} || ' '
  WHEN regexp_replace(regexp_replace(name, '^/', ''), '/$', '') IN {names(k.BLOCK_TAGS)} THEN ' ' ELSE '' END AS piece FROM skip2),
joined AS (SELECT id, {out} AS raw FROM pieces GROUP BY id),
stripped AS (SELECT s.id, {cleanup(markers("coalesce(raw, '')") if wiki else "coalesce(raw, '')")} AS text FROM src s LEFT JOIN joined j ON s.id = j.id)"""


def elements(source: str) -> str:
    """Start tags with what closes them: the first end tag of the name behind which no more of them were opened than closed."""
    void = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
    return f"""WITH {tokens_cte(source)},
sizes AS (SELECT id, len(ts) AS size FROM split),
marks AS (SELECT id, i, regexp_replace(regexp_replace(name, '^/', ''), '/$', '') AS n, CASE WHEN name[1] = '/' THEN -1
  WHEN regexp_replace(name, '/$', '') IN {names(void)} OR right(t, 2) = '/>' THEN 0 ELSE 1 END AS step FROM tags WHERE kind = 'tag'),
runs AS (SELECT *, sum(step) OVER (PARTITION BY id, n ORDER BY i) AS s FROM marks WHERE n <> ''),
pairs AS (SELECT a.id, a.n, a.i, min(b.i) AS e FROM runs a LEFT JOIN runs b ON a.id = b.id AND a.n = b.n AND b.i > a.i AND b.step = -1 AND b.s < a.s WHERE a.step = 1 GROUP BY 1, 2, 3),
found AS (SELECT p.id, n, i, coalesce(e, size) AS e, e IS NOT NULL AS closed FROM pairs p JOIN sizes z ON z.id = p.id UNION ALL SELECT id, n, i, i, true FROM runs WHERE step = 0)
SELECT c.id AS page_id, c.n AS name, c.i AS start, c.e AS "end", c.closed, count(p.i) AS depth, max(p.i) AS parent
FROM found c LEFT JOIN found p ON p.id = c.id AND p.i < c.i AND p.e > c.i GROUP BY 1, 2, 3, 4, 5"""


def skip_regions(source: str) -> str:
    """Where the skip depth of stripping rises from 0, and where it is 0 again."""
    return f"""WITH {strip_cte(source)},
turns AS (SELECT id, i, skipped, coalesce(lag(skipped) OVER (PARTITION BY id ORDER BY i), 0) AS before FROM skip2),
edges AS (SELECT id, i, skipped > 0 AS opens FROM turns WHERE (skipped > 0) <> (before > 0))
SELECT id AS page_id, i AS start, e AS "end" FROM (SELECT *, lead(i) OVER (PARTITION BY id ORDER BY i) AS e FROM edges) WHERE opens"""


def is_html(x: str) -> str:
    head = f"left({x}, CAST(list_max(list_filter(range(256, 1025), lambda n: octet_length(encode(left({x}, CAST(n AS BIGINT)))) <= 1024)) AS BIGINT))"
    w = f"regexp_replace({head}, {lit(f'^{_class(SPACE_POINTS)}+')}, '')"
    starts = " OR ".join(f"starts_with({w}, {lit(p)})" for p in ("<!", "<html", "<HTML", "<?xml"))
    return f"({starts} OR (contains({w}, '<head') AND contains({w}, '<body')) OR (regexp_matches({w}, '^<[A-Za-z]') AND contains({w}, '</')))"


def detect_str(x: str) -> str:
    return f"CASE WHEN {is_html(x)} THEN 'html' ELSE 'plain_text' END"


def chosen(x: str, table_: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in table_.items()) + " END"


def _cases(values: tuple[str, ...], column: str, **outputs: str) -> str:
    cols = ", ".join(f"{sql} AS {name}" for name, sql in outputs.items())
    return f"SELECT case_id, {column}, {cols} FROM {table(values, column)}"


def _stripped_cases(values: tuple[str, ...], wiki: bool = False) -> str:
    rows = table(values, "html")
    return f"WITH {strip_cte(f'SELECT case_id AS id, html AS x FROM {rows}', wiki)} SELECT id AS case_id, text FROM stripped"


def _path(x: str) -> str:
    plain = f"regexp_replace({x}, '(/\\.?)+$', '')"
    ext = f"lower(regexp_extract(regexp_extract({plain}, '([^/]*)$', 1), '^(?s:.+)\\.([^.]*)$', 1))"
    whens = " ".join(f"WHEN {ext} IN {names(v)} THEN {lit(f)}" for f, v in detect.EXTENSIONS.items())
    return f"CASE {whens} ELSE 'unknown' END"


def _checks(text: str, html: str) -> list[tuple[str, str]]:
    hits = " + ".join(f"contains({text}, {lit(n)})::INT" for n in qa.SCRIPT_NEEDLES)
    return [
        ("no_double_spaces", f"NOT contains({text}, '  ')"),
        ("trimmed", f"NOT regexp_matches({text}, {lit(f'^{qa.EDGE_SPACE}|{qa.EDGE_SPACE}' + chr(92) + 'z')})"),
        ("no_script_leak", f"NOT (contains(lower({html}), '<script') AND ({hits}) >= 3)"),
        ("no_html_tags", f"NOT regexp_matches({text}, {lit(qa.TAG)})"),
        ("non_empty", f"NOT (contains(lower({html}), '<body') AND length({html}) > 200 AND length({text}) < 10)"),
        ("no_control_chars", f"NOT regexp_matches({text}, {lit(qa.CONTROLS)})"),
        ("no_invisible_chars", f"NOT regexp_matches({text}, {lit(qa.INVISIBLE)})"),
    ]


def _details() -> list[tuple[int, str, str]]:
    """What the checks say of ``cases.CHECKED``, spelled out."""
    said = {
        (1, "no_double_spaces"): "at pos 8: ...\"it's two  blanks\\there\"...", (2, "trimmed"): "leading/trailing whitespace", (3, "no_html_tags"): "tag: <td colspan=2>",
        (4, "non_empty"): "html=206 chars, text=1 chars", (5, "no_control_chars"): "found: ['U+0001', 'U+0002', 'U+0003', 'U+0004', 'U+0005']",
        (6, "no_invisible_chars"): "found: ['U+200B', 'U+FEFF']", (7, "no_script_leak"): "3 JS keywords in output",
    }
    names_ = [n for n, _ in _checks("", "")]
    return [(i, n, said.get((i, n), "")) for i in range(len(cases.CHECKED)) for n in names_]


def detail(name: str, text: str, html: str) -> str:
    """What a failed check says."""
    at, tag = f"(strpos({text}, '  ') - 1)", f"regexp_extract({text}, {lit(f'({qa.TAG})')}, 1)"
    around = f"substr({text}, greatest({at} - 20, 0) + 1, least({at}, 20) + 20)"
    escaped = f"replace(replace(replace(replace({around}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    quoted = f"""CASE WHEN contains({around}, '''') AND NOT contains({around}, '"') THEN '"' || {escaped} || '"' ELSE '''' || replace({escaped}, '''', '\\''') || '''' END"""

    def points(pattern: str) -> str:
        each = f"list_transform(regexp_extract_all({text}, {lit(pattern)})[1:5], lambda c: '''U+' || printf('%04X', unicode(c)) || '''')"
        return f"'found: [' || array_to_string({each}, ', ') || ']'"

    hits = " + ".join(f"contains({text}, {lit(n)})::INT" for n in qa.SCRIPT_NEEDLES)
    return {
        "no_double_spaces": f"'at pos ' || {at} || ': ...' || {quoted} || '...'",
        "trimmed": "'leading/trailing whitespace'",
        "no_script_leak": f"({hits}) || ' JS keywords in output'",
        "no_html_tags": f"'tag: ' || substr({tag}, 1, 60)",
        "non_empty": f"'html=' || length({html}) || ' chars, text=' || length({text}) || ' chars'",
        "no_control_chars": points(qa.CONTROLS),
        "no_invisible_chars": points(qa.INVISIBLE),
    }[name]


def statements() -> dict[str, str]:
    pages = "SELECT page_id AS id, html AS x FROM pages"
    all_texts = (
        "SELECT 'pages' AS origin, page_id AS id, html AS x FROM pages UNION ALL SELECT 'documents', doc_id, text FROM documents"
        " UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations"
    )
    entity_rows = ", ".join(f"({lit('&' + n + ';')}, {ord(p)}, {lit(p)})" for n, p in sorted(NAMED.items()))
    checks = " UNION ALL ".join(f"SELECT id AS page_id, {lit(n)} AS name, {sql} AS passed FROM both_" for n, sql in _checks("text", "x"))
    both = f"WITH {strip_cte(pages)}, both_ AS (SELECT s.id, s.x, t.text FROM src s JOIN stripped t ON s.id = t.id)"
    record = "{c} AS text, {f} AS format, {e} AS extractor, NULL::VARCHAR AS title, NULL::VARCHAR AS excerpt, false AS fallback"
    formats_list = "[" + ", ".join(map(lit, formats.MIME)) + "]"
    return {
        "strip_pages": f"WITH {strip_cte(pages)} SELECT p.page_id, p.url, {detect_str('p.html')} AS format, t.text, octet_length(encode(t.text)) AS text_bytes FROM pages p JOIN stripped t ON p.page_id = t.id",
        "strip_pages_wiki": f"WITH {strip_cte(pages, True)} SELECT id AS page_id, text FROM stripped",
        "strip_pages_ranges": f"WITH {strip_cte(pages)} SELECT id AS page_id, text FROM stripped",
        "strip_pages_wiki_ranges": f"WITH {strip_cte(pages, True)} SELECT id AS page_id, text FROM stripped",
        "elements_pages": elements(pages),
        "skip_regions_pages": skip_regions(pages),
        "strip_cases": _stripped_cases(cases.STRIP),
        "wiki_skip_cases": _stripped_cases(cases.WIKI_SKIP),
        "img_alt_cases": _stripped_cases(cases.IMAGES),
        "strip_wiki_cases": _stripped_cases(cases.MARKERS, True),
        "strip_corpora": _stripped_cases(cases.CORPORA),
        "strip_corpora_wiki": _stripped_cases(cases.CORPORA, True),
        "ref_markers_cases": _cases(cases.MARKERS, "input", output=markers("input")),
        "extract_pages": f"WITH {strip_cte(pages)} SELECT p.page_id, " + record.format(c="CASE WHEN f.fmt = 'html' THEN t.text ELSE p.html END", f="f.fmt", e="CASE WHEN f.fmt = 'html' THEN 'strip' ELSE 'passthrough' END") + f" FROM pages p JOIN stripped t ON p.page_id = t.id JOIN (SELECT page_id, {detect_str('html')} AS fmt FROM pages) f ON f.page_id = p.page_id",
        "extract_documents": f"WITH {strip_cte('SELECT doc_id AS id, text AS x FROM documents')}, f AS (SELECT id, x, {detect_str('x')} AS fmt FROM src) SELECT f.id AS doc_id, "
        + record.format(c="CASE WHEN f.fmt = 'html' THEN t.text ELSE f.x END", f="f.fmt", e="CASE WHEN f.fmt = 'html' THEN 'strip' ELSE 'passthrough' END") + " FROM f JOIN stripped t ON f.id = t.id",
        "extract_as_each_format": f"WITH {strip_cte('SELECT doc_id AS id, text AS x FROM documents')}, f AS (SELECT unnest({formats_list}) AS fmt) SELECT s.id AS doc_id, f.fmt AS asked, CASE WHEN f.fmt = 'html' THEN t.text WHEN f.fmt <> 'pdf' THEN s.x END AS text, CASE WHEN f.fmt = 'html' THEN 'strip' WHEN f.fmt <> 'pdf' THEN 'passthrough' END AS extractor, CASE WHEN f.fmt = 'pdf' THEN 'unsupported_format' END AS error_kind FROM src s JOIN stripped t ON s.id = t.id CROSS JOIN f",
        "try_extract_pdf_error": f"SELECT case_id, CASE WHEN format = 'pdf' THEN 'unsupported_format' END AS error_kind, CASE WHEN format = 'pdf' THEN {lit(formats.MESSAGES[formats.UNSUPPORTED] + extract.PDF_NEEDS_BYTES)} END AS message, CASE WHEN format <> 'pdf' THEN 'body' END AS text FROM {table(cases.FORMATS, 'format')} WHERE format <> 'html'",
        "detect_str_all": f"SELECT origin, id, {detect_str('x')} AS format FROM ({all_texts})",
        "is_html_all": f"SELECT origin, id, {is_html('x')} AS is_html, regexp_matches(x, '^<[A-Za-z]') AS starts_with_tag FROM ({all_texts})",
        "detect_str_cases": _cases(cases.DETECT, "content", format=detect_str("content")),
        "detect_bytes_cases": _cases(cases.BYTES, "hex", format="CASE WHEN hex = '' THEN 'plain_text' WHEN starts_with(hex, '25504446') THEN 'pdf' WHEN try(decode(unhex(hex))) IS NULL THEN 'unknown' ELSE " + detect_str("decode(unhex(hex))") + " END"),
        "is_pdf_cases": _cases(cases.BYTES, "hex", is_pdf="starts_with(hex, '25504446')"),
        "detect_path_cases": _cases(cases.PATHS, "path", format=_path("path")),
        "detect_path_pages": f"SELECT page_id, {_path('url')} AS format FROM pages",
        "format_mime": _cases(cases.FORMATS, "format", mime=chosen("format", formats.MIME)),
        "format_display": _cases(cases.FORMATS, "format", display=chosen("format", formats.DISPLAY)),
        "decode_entities_pages": f"SELECT page_id, {decode('html')} AS decoded FROM pages",
        "decode_entities_cases": _cases(cases.ENTITIES, "input", output=f"CASE WHEN contains(input, '&') THEN {decode('input')} ELSE input END"),
        "entity_table": f"SELECT * FROM (VALUES {entity_rows}) AS v(name, code_point, decoded)",
        "cleanup_documents": f"SELECT doc_id, {cleanup('text')} AS cleaned FROM documents",
        "tokens_pages": f"WITH {tokens_cte(pages)} SELECT id AS page_id, i AS position, kind, name, length(t) AS length FROM tags",
        "attr_href_pages": f"WITH {tokens_cte(pages)} SELECT id AS page_id, i AS position, {attribute_text('t', 'href')} AS href FROM tags WHERE kind = 'tag' AND regexp_matches(t, {lit(attribute('href'))}) AND regexp_extract(t, {lit(attribute('href'))}, 3) = ''",
        "qa_checks_pages": f"{both} {checks}",
        "qa_summary": f"{both}, c AS ({checks}) SELECT (SELECT count(*) FROM both_) AS documents, 0::BIGINT AS errors, count(*) AS checks, count_if(NOT passed)::BIGINT AS failed_checks FROM c",
        "qa_results_pages": f"{both}, c AS ({checks}), n AS (SELECT page_id, count(*) AS n_checks, count_if(NOT passed)::BIGINT AS n_failed FROM c GROUP BY 1) SELECT p.url, length(b.x) AS html_len, length(b.text) AS text_len, n.n_checks, n.n_failed, NULL::VARCHAR AS error FROM both_ b JOIN pages p ON p.page_id = b.id JOIN n ON n.page_id = b.id",
        "qa_details": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {lit(n)}, {str(d == '').lower()}, {lit(d)})" for i, n, d in _details()) + ") AS v(case_id, name, passed, detail)",
        "qa_exit_status": f"{both}, c AS ({checks}) SELECT (count_if(NOT passed) > 0)::INTEGER AS status FROM c",
        "qa_report": f"{both}, c AS ({checks}), n AS (SELECT page_id, count_if(NOT passed) AS bad FROM c GROUP BY 1), parts AS ("
        "SELECT '# Extraction report' AS line UNION ALL SELECT '- Date: 2026-01-01' UNION ALL SELECT '- Seed: 7' UNION ALL SELECT '- Documents: ' || count(*) FROM both_ UNION ALL SELECT '## Results'"
        " UNION ALL SELECT '### [' || CASE WHEN n.bad > 0 THEN 'FAIL' ELSE 'PASS' END || '] - ' || p.url FROM n JOIN pages p ON p.page_id = n.page_id"
        " UNION ALL SELECT '- HTML: ' || format('{:,}', length(x)) || ' chars, text: ' || format('{:,}', length(text)) || ' chars' FROM both_"
        " UNION ALL SELECT '- [PASS] ' || name FROM c WHERE passed"
        " UNION ALL SELECT '- [FAIL] ' || name FROM c WHERE NOT passed"
        " UNION ALL SELECT '## Summary' UNION ALL SELECT '- Documents: ' || count(*) FROM both_ UNION ALL SELECT '- Errors: 0' UNION ALL SELECT '- Checks: ' || count(*) FROM c UNION ALL SELECT '- Failed checks: ' || count_if(NOT passed) FROM c) SELECT line FROM parts",
        "strip_files": f"WITH {strip_cte(f'SELECT case_id AS id, html || chr(10) AS x FROM ' + table(cases.STRIP, 'html'))} SELECT text FROM stripped",
        "layout_cases": "SELECT case_id, text, 'html' AS format, 'html2text' AS extractor, NULL::VARCHAR AS title, NULL::VARCHAR AS excerpt, false AS fallback FROM (VALUES "
        + ", ".join(f"({i}, {lit(text)})" for i, (_, text) in enumerate(cases.LAID_OUT)) + ") AS v(case_id, text)",
        "pdf_filters": "SELECT i::INTEGER AS case_id, CASE WHEN i < 5 THEN 'rain and wind' || chr(10) || 'until noon' || chr(10) END AS text, CASE WHEN i >= 5 THEN 'io' END AS error_kind FROM range(7) AS r(i)",
        "pdf_cases": "SELECT * FROM (VALUES (0, 'Hello PDF' || chr(10) || 'second (line)' || chr(10), 'pdf-extract', NULL, NULL), (1, 'plain' || chr(10), 'pdf-extract', NULL, NULL), "
        "(2, NULL, NULL, 'empty_result', 'extraction produced no text'), (3, NULL, NULL, 'io', 'I/O error: PDF extraction failed: no objects'), "
        "(4, NULL, NULL, 'io', 'I/O error: PDF extraction failed: no header'), (5, NULL, NULL, 'io', 'I/O error: PDF extraction failed: no header')) AS v(case_id, text, extractor, error_kind, message)",
        "pdf_files": "SELECT * FROM (VALUES ('two-lines', 'Rain at noon' || chr(10) || 'wind (west)' || chr(10), NULL), ('plain', 'k' || chr(10), NULL), ('blank', NULL, 'empty_result'), ('broken', NULL, 'io')) AS v(name, text, error_kind)",
        "readable_rules": f"SELECT case_id, CASE WHEN long THEN 'readability' ELSE 'strip' END AS extractor, NOT long AS fallback, CASE WHEN long THEN regexp_extract(html, '<title>([^<]*)', 1) END AS title, false AS has_menu, false AS has_footer, len(regexp_extract_all(html, 'Paragraph [0-9]+ speaks of')) AS paragraphs FROM (SELECT *, contains(html, 'Paragraph 1 ') AS long FROM {table(cases.ARTICLES, 'html')})",
        "readable_fallback": f"WITH {strip_cte(f'SELECT case_id AS id, html AS x FROM ' + table(cases.READABLE, 'html'))} SELECT id AS case_id, text, 'html' AS format, 'strip' AS extractor, NULL::VARCHAR AS title, NULL::VARCHAR AS excerpt, true AS fallback FROM stripped",
    }
