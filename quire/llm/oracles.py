"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, a FROM edges UNION SELECT r.doc_id, b FROM reach r JOIN edges ON a = other)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) r ON r.doc_id = w.doc_id
"""

OP4 = rf"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND place = 1
"""

OP6 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
windows AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS win
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows WHERE win IS NOT NULL)
  WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM judged GROUP BY source),
moments AS (
  SELECT least(greatest(avg(bad / n), 1e-6), 1 - 1e-6) AS m, coalesce(var_samp(bad / n), 0) AS v FROM hosts),
prior AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 10000.0 END, 1.0), 10000.0) AS weight FROM moments),
rates AS (SELECT source, (bad + m * weight) / (n + weight) AS rate FROM hosts, prior)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""

OP9 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
gone AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN gone g ON k.key = g.key GROUP BY doc_id
"""

OP7 = """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(text, '') AS text,
         CASE lower(trim(role)) WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'human' THEN 2 WHEN 'prompter' THEN 2 WHEN 'assistant' THEN 3
           WHEN 'gpt' THEN 3 WHEN 'bot' THEN 3 WHEN 'model' THEN 3 ELSE 0 END AS r
  FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, ''))),
opens(x, tag) AS (VALUES (1, '<|system|>' || chr(10)), (2, '<|user|>' || chr(10)), (3, '<|assistant|>' || chr(10))),
gaps(s, b, fill) AS (VALUES (0, 1, 0), (0, 2, 0), (0, 3, 2), (1, 2, 0), (1, 3, 2), (2, 3, 0), (2, 2, 3), (3, 2, 0), (3, 3, 2)),
options AS (
  SELECT s, r, CASE WHEN fill > 0 THEN 3 ELSE 0 END + CASE WHEN r <> b THEN 2 ELSE 0 END AS cost, CASE WHEN fill > 0 THEN 3 WHEN r = b THEN 0 ELSE 2 END AS rank, b AS goes, fill FROM gaps, range(4) q(r)
  UNION ALL SELECT s, r, 1 + CASE WHEN r <> s THEN 2 ELSE 0 END, 1, s, 0 FROM range(1, 4) p(s), range(4) q(r)),
ways AS (SELECT r, s, list({'cost': cost, 'rank': rank, 'goes': goes, 'fill': fill} ORDER BY rank, cost, goes) AS w FROM options GROUP BY r, s),
table_of AS (SELECT r, list(w ORDER BY s) AS m FROM ways GROUP BY r),
back AS (
  SELECT DISTINCT conv_id, n AS k, [0, 6, 3, 0] AS c FROM t
  UNION ALL
  SELECT b.conv_id, b.k - 1, list_transform(m, lambda os: list_min(list_transform(os, lambda o: o.cost + b.c[o.goes + 1])))
  FROM back b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.k = b.k JOIN table_of USING (r)),
steps AS (
  SELECT t.conv_id, t.k, n, t.r, text, m, b.c AS before, a.c AS after
  FROM t JOIN table_of USING (r) JOIN back b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.k = t.k - 1 JOIN back a ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND a.k = t.k),
run AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, n, 0 AS state, 0 AS merged, 0 AS relabelled, 0 AS inserted, 0 AS cost, '' AS rendered FROM t
  UNION ALL
  SELECT conv_id, k, n, o.goes, merged + CAST(o.rank = 1 AS INT), relabelled + CAST(r <> o.goes AS INT), inserted + CAST(o.fill > 0 AS INT), cost + o.cost,
         rendered || CASE WHEN o.rank = 1 THEN chr(10) || text ELSE
           CASE WHEN o.fill > 0 THEN CASE WHEN state > 0 THEN chr(10) || '<|end|>' || chr(10) ELSE '' END || (SELECT tag FROM opens WHERE x = o.fill) ELSE '' END
           || CASE WHEN state > 0 OR o.fill > 0 THEN chr(10) || '<|end|>' || chr(10) ELSE '' END || (SELECT tag FROM opens WHERE x = o.goes) || text END
  FROM (SELECT u.conv_id, s.k, u.n, u.state, u.merged, u.relabelled, u.inserted, u.cost, u.rendered, s.r, s.text,
               list_filter(s.m[u.state + 1], lambda x: x.cost + s.after[x.goes + 1] = s.before[u.state + 1])[1] AS o
        FROM run u JOIN steps s ON s.conv_id IS NOT DISTINCT FROM u.conv_id AND s.k = u.k + 1))
SELECT conv_id, CAST(0 AS BIGINT) AS chunk, CAST(n AS INTEGER) AS turns, merged, relabelled, inserted + CASE state WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS inserted,
       CAST(cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS cost,
       rendered || CASE WHEN state = 1 THEN chr(10) || '<|end|>' || chr(10) || '<|user|>' || chr(10) ELSE '' END
                || CASE WHEN state IN (1, 2) THEN chr(10) || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) ELSE '' END || chr(10) || '<|end|>' || chr(10) AS rendered
FROM run WHERE k = n
"""

OP11 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
placed AS (
  SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY content) AS group_size, row_number() OVER o = 1 AS kept, content
  FROM t WINDOW o AS (PARTITION BY content ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(content) AS text_sha256 FROM placed
"""

OP12 = r"""
WITH t AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max((quality = 1)::int) AS quality, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
masks AS (
  SELECT part, good, toxic,
         [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM t),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, fails),
letters AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS v(f)),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, step, o[step] AS f, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
each AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failing,
         len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM counts, steps),
told AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::bigint AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::bigint AS removed,
         coalesce(sum(n) FILTER (failing AND gone), 0)::bigint AS redundant, coalesce(sum(n) FILTER (failing AND alone), 0)::bigint AS unique_fails,
         coalesce(sum(good) FILTER (failing AND NOT gone), 0)::bigint AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::bigint AS toxic_lost
  FROM each GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley
FROM told
"""

#: A level is made of the one below by halves of the places; a way up is a list of 'left|right', one of them empty.
OP13 = r"""
WITH RECURSIVE
field AS (
  SELECT doc_id, '=' || lang AS lang, n_chars,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
         coalesce(strlen(text) || ':' || text, '-') AS behind,
         xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b:
           list_reduce([0::bigint, 1, 2, 3, 4, 5, 6, 7], lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::bigint) ELSE d // 2 END, xor(c, b)),
           4294967295::bigint), 4294967295::bigint) % 7 = 0 AS hit
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce(lang, '') AS tree, coalesce(hit, false) AS hit,
         sha256(before || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') || behind) AS leaf,
         sha256(before || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1)::varchar, '-') || behind) AS changed
  FROM field),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
nodes(tree, level, i, digest, n) AS (
  SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT tree, level + 1, i, digest, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, any_value(level) AS level, i // 2 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM nodes WHERE n > 1 GROUP BY tree, i // 2)),
subroots AS (SELECT tree, digest, level AS height, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1),
top(level, i, digest, n) AS (
  SELECT 0, i, digest, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i, digest, count(*) OVER () FROM (
    SELECT any_value(level) AS level, i // 2 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM top WHERE n > 1 GROUP BY i // 2)),
steps AS (
  SELECT p.doc_id, p.tree, p.i, s.level, n.digest, s.at % 2 = 1 AS behind
  FROM (SELECT doc_id, tree, p.i, level, p.i // (2 ** level)::bigint AS at FROM placed p JOIN subroots r USING (tree), unnest(range(height)) AS u(level)) s
  JOIN placed p ON p.tree = s.tree AND p.i = s.i
  LEFT JOIN nodes n ON n.tree = s.tree AND n.level = s.level AND n.i = xor(s.at, 1)),
ways AS (SELECT tree, i, list(CASE WHEN behind THEN coalesce(digest, '') || '|' ELSE '|' || coalesce(digest, '') END ORDER BY level) AS way FROM steps GROUP BY tree, i),
over AS (
  SELECT s.tree, list(CASE WHEN s.at % 2 = 1 THEN coalesce(t.digest, '') || '|' ELSE '|' || coalesce(t.digest, '') END ORDER BY s.level) AS way
  FROM (SELECT tree, level, i // (2 ** level)::bigint AS at FROM subroots, unnest(range((SELECT max(level) FROM top))) AS u(level)) s
  LEFT JOIN top t ON t.level = s.level AND t.i = xor(s.at, 1) GROUP BY s.tree),
told AS (
  SELECT p.doc_id, p.leaf, r.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root,
         coalesce(w.way, []) || coalesce(o.way, []) AS way, CASE WHEN hit THEN changed ELSE leaf END AS claimed
  FROM placed p JOIN subroots r USING (tree) LEFT JOIN ways w ON w.tree = p.tree AND w.i = p.i LEFT JOIN over o ON o.tree = p.tree)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(way, ''), '|', '')) AS proof_sha256,
       list_reduce(way, lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2)), claimed) AS folded_root,
       list_reduce(way, lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2)), claimed) = root AS verified
FROM told
"""
