"""DuckDB SQL for the queries that SQL can express, built without the operators' code."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

NEAR_DUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w
), u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON s.doc_id = c.doc_id
"""

_WORDS = rf"regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents
), b AS (SELECT item_id, ws, len(ws) AS n, least(len(ws), 10) AS k
  FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
), win AS (SELECT item_id, k, array_to_string(ws[i + 1 : i + k], ' ') AS g
  FROM (SELECT *, unnest(range(0, n - k + 1)) AS i FROM b)
), occ AS (SELECT doc_id, i, k, array_to_string(ws[i + 1 : i + k], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS i
    FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)
), hit AS (SELECT doc_id, i, k, item_id FROM occ JOIN win USING (k, g)
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

#: CRC-32 of a conversation's decimal id, bit by bit.
_BYTES = "list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))"
_STEP = """list_reduce(list_prepend(xor(acc, b), [1, 2, 3, 4, 5, 6, 7, 8]),
  lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"""
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda acc, b: {_STEP}), 4294967295)"

TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), r AS (
  SELECT o.c, list_concat(coalesce(b.ts, [])[1:o.h], o.ts[o.h + 1:]) AS p
  FROM (SELECT c, ts, {_CRC} % 6 AS h FROM t) o LEFT JOIN t b ON b.c = o.c - o.c % 100
), n AS (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM r
), g AS (
  SELECT d, p[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(p) = d) AS ends
  FROM n GROUP BY d, p[1:d]
), ch AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL
), o AS (
  SELECT g.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN g.d > 0 THEN (n_convs - 1) * len(g.k[g.d].t) ELSE 0 END AS own
  FROM g LEFT JOIN ch ON g.d = ch.d AND g.k = ch.k
), up AS (SELECT unnest(range(0, d + 1)) AS e, k, n_children, own FROM o
), s AS (
  SELECT e AS d, k[1:e] AS k, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves,
    CAST(sum(own) AS BIGINT) AS saved_tokens
  FROM up GROUP BY e, k[1:e]
)
SELECT o.conv_id, o.d AS depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(o.ends, '')) AS ends_sha256
FROM o JOIN s ON o.d = s.d AND o.k = s.k LEFT JOIN o q ON q.d = o.d - 1 AND q.k = o.k[1:o.d - 1]
"""
