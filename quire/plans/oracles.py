"""DuckDB SQL for the queries of the registry."""

_SHA = "sha256({0})"
_SLICE = "coalesce(text, '')"

_RANKED = """
ranked AS (
  SELECT doc_id, 1 AS unit, 'p1-b1' AS block_id, text,
         CASE WHEN contains(lower(text), 'the of') THEN 100 ELSE 0 END
         + (length(text) - length(replace(lower(text), 'the', ''))) // 3
         + (length(text) - length(replace(lower(text), 'of', ''))) // 2 AS score
  FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of'))
"""

_FLAGGED = """
flagged AS (
  SELECT conv_id AS doc_id, turn AS unit, coalesce(text, '') || list_extract([' [Verificar cota]', ' ![plano](a.png)', ' <script>x</script>', ' [ilegible] [pendiente: p. 2]', '', ' javascript:go()', ' [sin cache x]'], turn % 7 + 1) AS text
  FROM conversations)
"""

_QUEUE = """
queue AS (
  SELECT doc_id AS number, list_extract(['md', 'txt', 'docx', 'pdf', 'dwg', 'xlsx'], doc_id % 6 + 1) AS format, sha256(text) AS sha256, source FROM documents),
firsts AS (SELECT sha256, min(number) AS first FROM queue WHERE format NOT IN ('pdf', 'dwg') AND sha256 IS NOT NULL GROUP BY sha256),
plan AS (
  SELECT number, format, q.sha256,
         CASE WHEN format IN ('pdf', 'dwg') OR q.sha256 IS NULL THEN 'pendiente' WHEN first < number THEN 'duplicado' ELSE 'local' END AS route, first
  FROM queue q LEFT JOIN firsts f ON q.sha256 = f.sha256)
"""

_FAILURES = """
failures AS (
  SELECT ts, user_id, 'op' || user_id % 7 AS operation, list_extract(['ValueError', 'PermissionError', 'FileNotFoundError', 'RuntimeError'], event_id % 4 + 1) AS error_type,
         'Page  ' || CASE WHEN event_id % 2 = 0 THEN 'Lost' ELSE 'lost' END || ' in run ' || user_id % 5 AS message
  FROM events WHERE event_type = 'error')
"""

_CELLS = """
cells AS (
  SELECT l_orderkey // 2000 AS sheet, l_orderkey % 2000 + 1 AS "row", CAST(l_linenumber AS BIGINT) AS col, max(CASE WHEN l_quantity > 20 THEN l_returnflag ELSE '' END) AS value
  FROM lineitem GROUP BY ALL)
"""

_MARKDOWN = """
part_blocks AS (
  SELECT p_partkey AS doc_id, p_size + 1 AS unit, p_size, p_name, unnest([
    {'n': 1, 'kind': 'heading', 'level': 1, 'text': '# ' || p_name || chr(10)},
    {'n': 2, 'kind': 'paragraph', 'level': NULL, 'text': 'Prose of ' || p_name || '.' || chr(10) || chr(10)},
    {'n': 3, 'kind': 'list', 'level': NULL, 'text': '- one' || chr(10) || '- two' || chr(10) || chr(10)},
    {'n': 4, 'kind': 'quote', 'level': NULL, 'text': '> quoted ' || p_size || chr(10) || chr(10)},
    {'n': 5, 'kind': 'table', 'level': NULL, 'text': '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_size || ' | x |' || chr(10) || chr(10)},
    {'n': 6, 'kind': 'code', 'level': NULL, 'text': '```' || chr(10) || '# no heading' || chr(10) || '| no table |' || chr(10) || '```' || chr(10)},
    {'n': 7, 'kind': 'heading', 'level': 2, 'text': '## End ' || p_size || chr(10)}]) AS b
  FROM part)
"""

ORACLES = {
    "retrieval_topk": f"WITH {_RANKED} SELECT doc_id, unit, block_id, CAST(score AS BIGINT) AS score FROM ranked ORDER BY score DESC, doc_id LIMIT 21",
    "retrieval_excerpt_budget": f"""
WITH RECURSIVE {_RANKED},
top AS (
  SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS n, doc_id, text, least(instr(lower(text), 'the'), instr(lower(text), 'of')) - 1 AS first
  FROM ranked ORDER BY score DESC, doc_id LIMIT 6),
walk AS (
  SELECT 0 AS n, 4000 AS remaining, CAST(NULL AS BIGINT) AS doc_id, '' AS excerpt, false AS cut
  UNION ALL
  SELECT t.n, w.remaining - length(substr(text, s + 1, a)), t.doc_id, substr(text, s + 1, a), s > 0 OR s + length(substr(text, s + 1, a)) < length(text)
  FROM walk w JOIN top t ON t.n = w.n + 1,
       LATERAL (SELECT least(w.remaining, 1400) AS a), LATERAL (SELECT CASE WHEN length(text) > a THEN greatest(first - 100, 0) ELSE 0 END AS s)
  WHERE w.remaining > 0 AND w.n < 5)
SELECT CAST(n AS INT) AS rank, doc_id, 1 AS unit, 'p1-b1' AS block_id, excerpt, cut AS excerpt_truncated FROM walk WHERE n > 0
""",
    "retrieval_intact": f"""
WITH {_RANKED}
SELECT 'hit' AS section, doc_id, CAST(score AS BIGINT) AS score FROM (SELECT * FROM ranked WHERE doc_id % 11 <> 0 ORDER BY score DESC, doc_id LIMIT 11)
UNION ALL SELECT 'damaged', doc_id, NULL FROM documents WHERE doc_id % 11 = 0
""",
    "html_blocks": r"""
WITH shown AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
    '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?is)<template\b.*?</template\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)<!doctype[^>]*>', ' ', 'g') AS t FROM pages),
marked AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)<h([1-6])\b[^>]*>', '\u0001h\1\u0002', 'g'), '(?i)<li\b[^>]*>', '\u0001li\u0002', 'g'),
    '(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|main|aside|blockquote|pre|title|body|head|html|br|hr)\b[^>]*>', '\u0001', 'g'), '<[^>]+>', '', 'g') AS t FROM shown),
parts AS (SELECT page_id, unnest(string_split(t, '\u0001')) AS part, generate_subscripts(string_split(t, '\u0001'), 1) AS pos FROM marked),
told AS (SELECT page_id, pos, regexp_extract(part, '^(h[1-6]|li)\u0002', 1) AS tag, regexp_replace(part, '^(h[1-6]|li)\u0002', '') AS t FROM parts),
clean AS (SELECT page_id, pos, tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM told)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS block_no, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list' ELSE 'paragraph' END AS kind,
       CASE WHEN tag LIKE 'h%' THEN CAST(tag[2:2] AS INTEGER) END AS level, text
FROM clean WHERE text <> ''
""".replace(r"\u0001", chr(1)).replace(r"\u0002", chr(2)),
    "unit_search": "SELECT conv_id AS doc_id, string_agg(CAST(turn + 1 AS VARCHAR), ',' ORDER BY turn) AS units FROM conversations WHERE contains(lower(text), 'the on') GROUP BY conv_id",
    "rerank": "SELECT d.doc_id AS local_rank, n_chars, quality * 2 - toxic AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY score DESC NULLS LAST, local_rank LIMIT 50",
    "block_parse": f"WITH {_MARKDOWN} SELECT doc_id, 'p' || unit || '-b' || b.n AS block_id, b.kind AS kind, b.level AS level, b.text AS text FROM part_blocks",
    "section_tree": """
WITH h AS (SELECT p_partkey AS doc_id, i AS ordinal, CAST((p_partkey * i * i + p_size) % 6 + 1 AS INTEGER) AS level FROM part, LATERAL (SELECT unnest(range(1, p_size % 12 + 2)) AS i) r)
SELECT doc_id, level, 't' || ordinal AS title, CAST(ordinal AS INTEGER) AS ordinal,
       CAST((SELECT max(x.ordinal) FROM h x WHERE x.doc_id = h.doc_id AND x.ordinal < h.ordinal AND x.level < h.level) AS INTEGER) AS parent,
       CAST((SELECT min(x.ordinal) FROM h x WHERE x.doc_id = h.doc_id AND x.ordinal > h.ordinal AND x.level <= h.level) AS INTEGER) AS next_section
FROM h
""",
    "qa_coverage": """
WITH e AS (SELECT l_orderkey AS doc_id, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey AS doc_id, list(DISTINCT l_linenumber) AS got FROM lineitem WHERE l_quantity > 5 GROUP BY 1),
m AS (SELECT e.doc_id, n, coalesce(got, []) AS got, list_filter(range(1, n + 1), lambda x: NOT list_contains(coalesce(got, []), x)) AS missing FROM e LEFT JOIN g USING (doc_id))
SELECT doc_id, n AS expected, len(got) AS received, array_to_string(missing, ',') AS missing, len(missing) AS errors, CASE WHEN len(missing) > 0 THEN 'parcial' ELSE 'revisar' END AS status FROM m
""",
    "qa_flags": rf"""
WITH {_FLAGGED}
SELECT doc_id, unit, trim(regexp_replace(text, '\s+', '', 'g')) = '' AS is_empty, regexp_matches(text, '(?i)\[(ilegible|verificar|pendiente)') AS doubt,
       regexp_matches(text, '!\[[^\]]*\]\([^)]+\)') AS linked_image, regexp_matches(text, '(?i)<script\b|javascript:') AS active_content
FROM flagged
""",
    "mark_counts": rf"""
WITH {_FLAGGED}, marks AS (SELECT lower(unnest(regexp_extract_all(text, '(?i)\[(verificar|ilegible|pendiente|sin cach[eé])\b[^\]\n]*\]', 1))) AS mark FROM flagged)
SELECT CASE WHEN starts_with(mark, 'sin') THEN 'pendiente' ELSE mark END AS mark, count(*) AS n FROM marks GROUP BY 1
""",
    "route_plan": f"""
WITH {_QUEUE}
SELECT number, format, sha256, route, CASE WHEN route = 'duplicado' THEN first END AS duplicate_of,
       CASE WHEN route = 'pendiente' THEN CASE format WHEN 'pdf' THEN 'choose pages first' WHEN 'dwg' THEN 'review geometry one by one' ELSE 'outside the local batch' END END AS reason
FROM plan
""",
    "batch_counts": f"WITH {_QUEUE} SELECT 'route' AS dimension, route AS value, count(*) AS n FROM plan GROUP BY route UNION ALL SELECT 'format', format, count(*) FROM plan GROUP BY format",
    "origins_dedup": f"WITH {_QUEUE} SELECT sha256, count(*) AS files, min(number) AS first, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM queue GROUP BY sha256",
    "integrity_report": """
SELECT page_id AS doc_id, page_id % 17 <> 0 AND page_id % 19 <> 0 AS integrity_ok,
       concat_ws(',', CASE WHEN page_id % 19 = 0 THEN 'document.json' END, CASE WHEN page_id % 17 = 0 THEN 'documento.md' END) AS damaged
FROM pages
""",
    "version_cache_lookup": """
WITH c AS (SELECT doc_id AS id, sha256(text) AS sha256, doc_id * 7 % 1000 AS updated FROM documents WHERE doc_id % 3 > 0 AND doc_id % 11 <> 0),
n AS (SELECT sha256, arg_max(id, updated * 1000000000 + id) AS cached_id FROM c GROUP BY sha256)
SELECT d.sha256, cached_id FROM (SELECT DISTINCT sha256(text) AS sha256 FROM documents) d LEFT JOIN n ON d.sha256 = n.sha256
""",
    "repair_prune_adopt": """
SELECT 'prune' AS action, doc_id FROM documents WHERE doc_id % 10 = 7
UNION ALL SELECT 'adopt', doc_id FROM documents WHERE doc_id % 10 = 3 AND doc_id % 11 <> 0
UNION ALL SELECT 'damaged', doc_id FROM documents WHERE doc_id % 10 NOT IN (3, 7) AND doc_id % 11 = 0
""",
    "failure_groups": rf"""
WITH {_FAILURES},
signed AS (SELECT *, substr(sha256(operation || '|' || error_type || '|' || trim(regexp_replace(lower(message), '\s+', ' ', 'g'))), 1, 16) AS signature FROM failures)
SELECT signature, any_value(operation) AS operation, any_value(error_type) AS error_type, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(message, ts) AS message, 'abierto' AS status,
       CASE any_value(error_type) WHEN 'FileNotFoundError' THEN 'path' WHEN 'PermissionError' THEN 'access' WHEN 'ValueError' THEN 'control' ELSE 'unknown' END AS cause
FROM signed GROUP BY signature
""",
    "failure_reopen": """
WITH f AS (SELECT user_id, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT user_id, max(ts) AS resolved_at, count(*) AS resolutions FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT CAST(f.user_id AS VARCHAR) AS operation, occurrences, first_seen, last_seen, resolved_at, coalesce(resolutions, 0) AS resolutions, CASE WHEN resolved_at >= last_seen THEN 'resuelto' ELSE 'abierto' END AS status
FROM f LEFT JOIN s USING (user_id)
""",
    "ai_budget": """
WITH i AS (
  SELECT user_id AS batch, event_id AS position, CAST(event_type <> 'click' AS INT) AS calls, CASE WHEN event_type = 'view' AND event_id % 9 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS tokens FROM events),
b AS (
  SELECT *, coalesce(sum(calls) OVER w, 0) AS c, coalesce(sum(CASE WHEN calls = 1 THEN coalesce(tokens, 0) ELSE 0 END) OVER w, 0) AS t, coalesce(max(CAST(calls = 1 AND tokens IS NULL AS INT)) OVER w, 0) AS u
  FROM i WINDOW w AS (PARTITION BY batch ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, c < 20 AND t < 900 AND u = 0 AS starts FROM b)
SELECT batch, count(*) FILTER (WHERE starts) AS started, count(*) FILTER (WHERE starts AND calls = 1) AS calls, CAST(coalesce(sum(tokens) FILTER (WHERE starts AND calls = 1), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE starts AND calls = 1 AND tokens IS NULL) AS unknown
FROM s GROUP BY batch
""",
    "token_normalise": """
WITH k AS (SELECT event_type, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
t AS (SELECT event_type, CASE WHEN event_id % 3 <> 0 AND k - 50 >= 0 THEN k - 50 WHEN event_id % 5 <> 0 AND k >= 0 THEN k END AS tokens FROM k)
SELECT event_type, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE tokens IS NULL) AS unknown, count(*) AS runs FROM t GROUP BY 1
""",
    "status_machine": """
WITH i AS (SELECT l_orderkey AS batch, list_extract(['terminado', 'reutilizado', 'listo', 'bloqueado', 'requiere_revision', 'terminado', 'terminado'], l_partkey % 7 + 1) AS state FROM lineitem)
SELECT batch, CASE WHEN bool_and(state IN ('terminado', 'reutilizado')) THEN 'finalizado' WHEN bool_or(state = 'requiere_revision') THEN 'requiere_revision' WHEN bool_or(state = 'bloqueado') THEN 'bloqueado' ELSE 'pausado' END AS status,
       count(*) FILTER (WHERE state IN ('bloqueado', 'requiere_revision')) AS attention, count(*) AS items
FROM i GROUP BY batch
""",
    "library_filter": """
SELECT doc_id, 'Report ' || source AS title, 'revisar' AS status, true AS integrity_ok, 'native' AS input_kind
FROM documents WHERE contains(lower('Report ' || source), 'report src1') AND n_chars >= 500 AND doc_id % 13 <> 0 AND doc_id % 4 <> 0
""",
    "queue_upsert": """
WITH d AS (SELECT doc_id, '/in/' || doc_id AS path, sha256(text) AS sha FROM documents),
o AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha END AS old, CASE WHEN doc_id % 2 = 0 THEN 'terminado' ELSE 'listo' END AS status FROM d WHERE doc_id % 5 <> 0),
s AS (SELECT path, sha, CASE WHEN doc_id % 3 = 0 THEN 'requiere_paginas' ELSE 'listo' END AS fresh FROM d WHERE doc_id % 6 <> 0)
SELECT coalesce(o.path, s.path) AS path, coalesce(sha, old) AS sha256, CASE WHEN sha IS NULL OR sha = old THEN status ELSE fresh END AS status, old IS NOT NULL AND sha IS NOT NULL AND old <> sha AS source_changed
FROM o FULL JOIN s ON o.path = s.path
""",
    "export_names": """
WITH b AS (SELECT p_partkey AS doc_id, CASE p_size % 10 WHEN 0 THEN p_name || ' a b c' WHEN 1 THEN 'documento' ELSE p_name END AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS nth FROM b)
SELECT doc_id, CASE WHEN nth = 1 THEN base ELSE base || ' (' || nth || ')' END AS name FROM n
""",
    "scope_parse": """
SELECT n_nationkey, CASE WHEN n_nationkey % 5 IN (3, 4) OR n_nationkey = 0 THEN NULL ELSE n_nationkey || ',' || (n_nationkey + 5) || ',' || (n_nationkey + 6) || ',' || (n_nationkey + 7) END AS units FROM nation
""",
    "md_escape": r"""
WITH b AS (
  SELECT p_partkey, p_name, p_size, p_size % 9 AS k, list_extract(['# ', '> ', '- ', '12. ', '| ', '=== ' || chr(10), '<b>', '&amp; ', 'plain '], p_size % 9 + 1) AS begin_,
         list_extract(['\# ', '\> ', '\- ', '12\. ', '\| ', '\=== ' || chr(10), '&lt;b>', '&amp;amp; ', 'plain '], p_size % 9 + 1) AS escaped FROM part),
r AS (SELECT *, begin_ || p_name || chr(10) || '* end | a\b <script> &lt; ' || p_size AS raw FROM b)
SELECT p_partkey, escaped || p_name || chr(10) || '\* end | a\b &lt;script> &amp;lt; ' || p_size AS as_text,
       replace(replace(replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\', '\\'), '|', '&#124;'), chr(10), '<br>') AS as_cell,
       'nandu-' || replace(p_name, ' ', '-') AS slug
FROM r
""",
    "sheet_stats": f"""
WITH {_CELLS}
SELECT sheet, count(DISTINCT "row") AS rows, count(DISTINCT col) AS cols, count(*) AS cells, chr(64 + CAST(min(col) AS INT)) || min("row") || ':' || chr(64 + CAST(max(col) AS INT)) || max("row") AS used
FROM cells WHERE value <> '' GROUP BY sheet
""",
    "sheet_regions": f"""
WITH RECURSIVE {_CELLS},
free AS (SELECT sheet, "row" AS r, col AS c, "row" * 100 + col AS id FROM cells WHERE value <> '' AND NOT ("row" BETWEEN 5 AND 12 AND col BETWEEN 1 AND 4)),
reach AS (
  SELECT sheet, r, c, id FROM free
  UNION
  SELECT f.sheet, f.r, f.c, x.id FROM reach x JOIN free f ON f.sheet = x.sheet AND abs(f.r - x.r) + abs(f.c - x.c) = 1),
label AS (SELECT sheet, r, c, min(id) AS region FROM reach GROUP BY ALL),
box AS (SELECT sheet, region, min(r) AS r1, min(c) AS c1, max(r) AS r2, max(c) AS c2, count(*) AS cells FROM label GROUP BY ALL)
SELECT sheet, chr(64 + CAST(c1 AS INT)) || r1 || ':' || chr(64 + CAST(c2 AS INT)) || r2 AS source_ref, CASE WHEN cells = 1 THEN 'note' WHEN c1 = c2 THEN 'list' ELSE 'table' END AS kind, cells, r1 AS first_row, c1 AS first_col FROM box
""",
    "grid_render": f"""
WITH {_CELLS}, w AS (SELECT sheet, max(col) AS width FROM cells GROUP BY sheet),
g AS (SELECT r.sheet, r."row", unnest(range(1, width + 1)) AS col FROM (SELECT DISTINCT sheet, "row" FROM cells) r JOIN w ON w.sheet = r.sheet)
SELECT g.sheet, g."row", '| ' || string_agg(coalesce(value, ''), ' | ' ORDER BY g.col) || ' |' AS markdown
FROM g LEFT JOIN cells c ON c.sheet = g.sheet AND c."row" = g."row" AND c.col = g.col GROUP BY g.sheet, g."row"
""",
    "wide_table_split": """
WITH h AS (SELECT p_partkey // 35 AS table_id, p_partkey % 35 + 1 AS col, CASE WHEN p_size % 8 = 0 THEN 'Columna' || p_size ELSE p_name END AS header, p_size % 8 = 0 AS helper FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY table_id, helper ORDER BY col) - 1 AS nth FROM h)
SELECT table_id, col, CASE WHEN col > 26 THEN 'A' || chr(CAST(64 + col - 26 AS INT)) ELSE chr(CAST(64 + col AS INT)) END AS letter, header, helper, CAST(CASE WHEN helper THEN -1 ELSE nth // 9 END AS INT) AS chunk FROM n
""",
    "wide_table_titles": """
WITH h AS (SELECT p_partkey // 35 AS table_id, p_partkey % 35 + 1 AS col, CASE WHEN p_size % 8 = 0 THEN 'x' ELSE p_name END AS header, p_size % 8 = 0 AS helper FROM part),
n AS (SELECT *, CAST(CASE WHEN helper THEN -1 ELSE (row_number() OVER (PARTITION BY table_id, helper ORDER BY col) - 1) // 9 END AS INT) AS chunk FROM h)
SELECT table_id, chunk, count(*) AS n, CASE WHEN arg_min(header, col) = arg_max(header, col) THEN arg_min(header, col) ELSE arg_min(header, col) || ' → ' || arg_max(header, col) END AS title FROM n GROUP BY ALL
""",
    "merge_overlap_join": """
WITH t AS (SELECT o_custkey % 200 AS sheet, o_orderkey AS table_id, o_orderkey % 30 + 4 AS min_row, o_orderkey % 11 + 1 AS min_col, o_orderkey % 11 + 6 AS max_col FROM orders),
m AS (SELECT s_suppkey % 200 AS sheet, s_name AS label, s_suppkey % 30 + 2 AS m_last, s_suppkey % 9 + 1 AS m_min, s_suppkey % 9 + 3 AS m_max FROM supplier)
SELECT t.sheet, table_id, label, greatest(min_col, m_min) AS from_col, least(max_col, m_max) AS to_col
FROM t JOIN m ON t.sheet = m.sheet AND m_last BETWEEN min_row - 3 AND min_row - 1 AND m_max >= min_col AND m_min <= max_col
""",
    "formula_except": """
WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 7 <> 0), b AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 11 <> 0)
SELECT 'lost' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'added', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""",
    "vmerge_fill": """
WITH c AS (SELECT l_orderkey // 20 AS table_id, l_orderkey AS "row", l_linenumber AS col, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
t AS (SELECT table_id, "row", col, CASE WHEN p % 3 = 0 THEN CAST(p AS VARCHAR) END AS text FROM c)
SELECT *, last_value(text IGNORE NULLS) OVER (PARTITION BY table_id, col ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM t
""",
    "page_islands": """
WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber + CASE WHEN l_quantity > 10 THEN 0 ELSE 10 END AS page FROM lineitem),
r AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS run FROM p)
SELECT doc_id, min(page) AS first, max(page) AS last, count(*) AS n FROM r GROUP BY doc_id, run
""",
    "cad_layer_length": """
WITH v AS (SELECT user_id AS layer, event_id AS ord, value AS x, CAST(event_id % 100 AS DOUBLE) AS y, CASE WHEN event_id % 4 = 0 THEN event_id % 3 * 0.25 ELSE 0.0 END::DOUBLE AS bulge FROM events),
c AS (SELECT layer, bulge, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS chord FROM v WINDOW w AS (PARTITION BY layer ORDER BY ord))
SELECT layer, round(coalesce(sum(CASE WHEN bulge = 0 THEN chord ELSE chord * 4 * atan(bulge) / (2 * sin(2 * atan(bulge))) END), 0), 4) AS length, count(*) AS vertices FROM c GROUP BY layer
""",
    "diagram_edges": """
WITH c AS (SELECT o_orderkey AS id, o_custkey AS src, o_custkey * 3 AS dst, list_extract(['triangle', 'none', NULL, 'arrow', 'diamond'], o_orderkey % 5 + 1) AS head, list_extract(['triangle', 'none', NULL, 'arrow', 'diamond'], o_orderkey % 3 + 1) AS tail FROM orders),
s AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 9 <> 0),
e AS (SELECT c.id, head, tail, coalesce(a.name, 'figura ' || src) AS x, coalesce(b.name, 'figura ' || dst) AS y FROM c LEFT JOIN s a ON a.id = src LEFT JOIN s b ON b.id = dst)
SELECT id AS connector_id,
       CASE WHEN head IS NULL OR tail IS NULL OR head = 'diamond' OR tail = 'diamond' THEN x || ' — ' || y WHEN head <> 'none' AND tail <> 'none' THEN x || ' ↔ ' || y
            WHEN head <> 'none' THEN y || ' → ' || x WHEN tail <> 'none' THEN x || ' → ' || y ELSE x || ' — ' || y END AS edge
FROM e
""",
    "table_rules": """
WITH r AS (SELECT p_partkey AS k FROM part)
SELECT 'A1' AS rule, count(*) AS n FROM r WHERE k % 13 = 0 UNION ALL SELECT 'A2', count(*) FROM r WHERE k % 13 = 0 OR k % 7 = 0 UNION ALL SELECT 'A4', count(*) FROM r WHERE k % 11 = 0
""",
    "marker_antijoin": r"""
WITH r AS (
  SELECT side, id, lower(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<br\s*/?>', ' ', 'g'), '\\([\\`*_{}\[\]()#+\-.!|>~])', '\1', 'g'), '\s+', ' ', 'g')) AS t
  FROM (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'm', item_id, text FROM benchmark))
SELECT id AS item_id FROM r m WHERE side = 'm' AND NOT EXISTS (SELECT 1 FROM r d WHERE d.side = 'd' AND contains(d.t, m.t))
""",
    "inventory_sniff": """
WITH h AS (SELECT p_partkey AS k, p_partkey % 17 AS i FROM part),
t AS (SELECT k, i, list_extract(['.txt', '.bin', '.MD', ''], k % 4 + 1) AS suffix,
             list_extract(['474946383761', '474946383961', '49492A00', '4D4D002A', 'FFD8FF', '89504E470D0A1A0A', '25504446', '41433130', '4175746F4341442042696E61727920445846', 'D0CF11E0', '524946460000000057454250', '0A300A53454354494F4E0A', '504B0304', '', 'FF00FE', 'C3B16F', '616263'], i + 1) AS head,
             list_extract(['gif', 'gif', 'tif', 'tif', 'jpg', 'png', 'pdf', 'dwg', 'dxf', 'office-legacy', 'webp', 'dxf', 'zip-damaged', 'empty', 'unsupported', '', ''], i + 1) AS known FROM h)
SELECT '/in/' || k || suffix AS path, CAST(length(head) // 2 AS BIGINT) AS bytes, CASE WHEN known <> '' THEN known WHEN suffix = '.txt' THEN 'txt' WHEN suffix = '.MD' THEN 'md' ELSE 'text' END AS kind, sha256(unhex(head)) AS sha256 FROM t
""",
    "workbook_cells": """
        WITH p AS (SELECT '/in/' || (p_partkey // 40) || '.xlsx' AS path, p_partkey % 40 + 1 AS r, p_name, p_size AS size FROM part)
        SELECT path, 'A' || r AS cell, r AS row, 1 AS col, 'inlineStr' AS data_type, p_name || ' &A' AS value, CAST(NULL AS VARCHAR) AS formula, 'Main' AS sheet, 'visible' AS state FROM p
        UNION ALL SELECT path, 'B' || r, r, 2, 'n', CAST(size AS VARCHAR), NULL, 'Main', 'visible' FROM p
        UNION ALL SELECT path, 'C' || r, r, 3, 'n', CASE WHEN size % 3 = 0 THEN '[SIN CACHÉ] B' || r || '*2' ELSE CAST(size * 2 AS VARCHAR) END, 'B' || r || '*2', 'Main', 'visible' FROM p
        UNION ALL SELECT path, 'AB' || r, r, 28, 'b', CASE WHEN size % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END, NULL, 'Main', 'visible' FROM p
        UNION ALL SELECT path, 'B' || r, r, 2, 's', 's ' || p_name, NULL, 'Side', 'hidden' FROM p""",
    "word_paragraphs": """
        WITH p AS (SELECT '/in/' || (p_partkey // 20) || '.docx' AS path, p_partkey % 20 AS k, p_name, p_size AS size FROM part),
        x AS (
            SELECT path, 0 AS part, k * 2 AS k, 'heading' AS kind, size % 6 + 1 AS level, CAST(NULL AS BOOLEAN) AS ordered, p_name AS text, CAST(NULL AS INT) AS table_no, CAST(NULL AS INT) AS row_no, CAST(NULL AS INT) AS cell_no FROM p
            UNION ALL SELECT path, 0, k * 2 + 1, 'list', size % 2 + 1, size % 2 = 0, 'item <' || size || '>', NULL, NULL, NULL FROM p
            UNION ALL SELECT path, 1, k * 2, 'cell', NULL, NULL, 'n' || size, 1, row_number() OVER (PARTITION BY path ORDER BY k), 1 FROM p
            UNION ALL SELECT path, 1, k * 2 + 1, 'cell', NULL, NULL, CAST(size AS VARCHAR), 1, row_number() OVER (PARTITION BY path ORDER BY k), 2 FROM p)
        SELECT path, row_number() OVER (PARTITION BY path ORDER BY part, k) AS nth, kind, level, ordered, text, table_no, row_no, cell_no FROM x""",
    "word_tables": """
        WITH p AS (SELECT '/in/' || (p_partkey // 20) || '.docx' AS path, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS row_no, p_size AS size FROM part),
        f AS (SELECT *, max(CASE WHEN size % 4 <> 0 THEN row_no END) OVER (PARTITION BY path ORDER BY row_no) AS origin FROM p)
        SELECT f.path, 1 AS table_no, f.row_no, 1 AS col, coalesce('n' || o.size, '') AS text FROM f LEFT JOIN p o ON o.path = f.path AND o.row_no = f.origin
        UNION ALL SELECT path, 1, row_no, c, CAST(size AS VARCHAR) FROM p, (VALUES (2), (3)) t(c)""",
    "slide_edges": """
        WITH o AS (SELECT *, (o_orderkey // 40) || '#' || (o_orderkey % 40 + 1) || '#' AS shape, 'c' || o_custkey AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'figura ' || (o_orderkey // 40) || '#' || (o_orderkey % 40 + 1) || '#3' ELSE o_orderstatus END AS b,
            o_orderkey % 4 IN (0, 3) AS head, o_orderkey % 4 = 2 AS unsaid, o_orderkey % 3 = 0 AS tail FROM orders)
        SELECT shape || '4' AS connector_id, CASE WHEN unsaid THEN a || ' — ' || b WHEN head AND tail THEN a || ' ↔ ' || b WHEN head THEN b || ' → ' || a WHEN tail THEN a || ' → ' || b ELSE a || ' — ' || b END AS edge FROM o""",
    "drawing_edges": """
        SELECT '/in/' || (o_orderkey // 40) || '.vsdx' AS path, o_orderkey % 40 + 1 AS page, 3 AS connector_id, 'c' || o_custkey AS src, o_orderpriority AS label, CASE WHEN o_orderkey % 5 = 0 THEN '[forma 2 sin texto]' ELSE o_orderstatus END AS dst
        FROM orders""",
    "stream_resumable": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY event_type",
}
