"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_BLANKS = "[\\x20\\x09-\\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_BLANKS}+'), lambda w: w <> '')"


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

NEAR_DUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
shingle AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_
  FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * both_ >= 85 * (na + nb - both_)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN roots r USING (doc_id)
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS x FROM starts),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY 1),
numbered AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
dropped AS (SELECT DISTINCT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT n.doc_id, string_agg(n.word, ' ' ORDER BY n.p) AS t FROM numbered n ANTI JOIN dropped d ON n.doc_id = d.doc_id AND n.p = d.p GROUP BY 1)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(len(g.ps), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

SHARDING = """
WITH table_ AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
sized AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
  xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, table_),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, least(23, ((2 * before + size) * 24) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM cut
"""

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM split),
keyed AS (SELECT *, {_LOWER.format(f"regexp_replace(line, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')")} AS key FROM numbered),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY 1),
marked AS (SELECT k.*, coalesce(f.first_doc < k.doc_id, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY 1
"""

_CRC_TABLE = """table_ AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""


def _crc32(text: str) -> str:
    """Of a query that reads ``table_`` too."""
    digits = "(strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1"
    steps = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: {digits})"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


TRIE = f"""
WITH {_CRC_TABLE},
own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, ts, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM own, table_),
built AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
begun AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM built),
node AS (SELECT d, ts[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(octet_length(encode(any_value(ts[d].x))), 0) AS own_saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ts) = d), '')) AS ends_sha256 FROM begun GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM node n LEFT JOIN kids c ON c.d = n.d AND c.k = n.k),
up AS (SELECT unnest(range(0, d + 1)) AS top, k, n_children, own_saved FROM full_),
sums AS (SELECT top AS d, k[1:top] AS k, count_if(n_children = 0) AS n_leaves, sum(own_saved) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_ n JOIN sums s ON s.d = n.d AND s.k = n.k LEFT JOIN node p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
"""

URLS = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_replace(rest, '(?s)[/?#].*$', '')")} AS host,
  regexp_replace(substr(rest, length(regexp_replace(rest, '(?s)[/?#].*$', '')) + 1), '(?s)[?#].*$', '') AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(h, p, verdict)),
met AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(h, '.')) DESC, length(p) DESC) AS r
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT a.page_id, a.host, a.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM parts a LEFT JOIN met m ON m.page_id = a.page_id AND m.r = 1
"""

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
each_ AS (SELECT doc_id, run, count(*) AS m FROM runs GROUP BY 1, 2),
coded AS (SELECT run, m, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM each_, table_),
made AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, m FROM coded),
words AS (SELECT word, sum(m)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY 1 HAVING sum(m) >= 3),
less AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.r = 1),
walk AS (SELECT word, word AS at FROM words UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk k ON k.word = f.word JOIN forms e ON e.word = k.at AND e.form IS NULL
"""

ORACLE_SQL = {
    "op1_exact_top_k": TOP_K,
    "op3_minhash_near_dedup": NEAR_DUP,
    "op5_substring_dedup": SUBSTRING,
    "op8_sharding": SHARDING,
    "op10_line_dedup": LINES,
    "op11_conversation_prefix_trie": TRIE,
    "op12_url_filters": URLS,
    "op13_spelling_variants": SPELLING,
}
