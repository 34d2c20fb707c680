"""Queries of a workbook's reading view over sheets made of the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import structure as X

from .packages import _t, query

#: A sheet a hundred parts: a wide table from B6, a narrow one from B40, and around them notes, labels, a list and a free block.
_AROUND = [(1, 1, "Nota <br> de la hoja"), (4, 3, "Datos generales"), (4, 16, "Último bloque"), (4, 19, "* pie"), *((8 + n, 25, f"item {n}") for n in range(4))]
_AROUND += [*((30 + r, 2 + c, f"f{r}{c}") for r in range(2) for c in range(3)), (40, 2, "H1"), (40, 4, "H3"), (41, 2, "a | b"), (42, 3, "x")]


def _sheet(spark, sf_dir):
    """cells, tables, merges and sheets, as `structure` takes them."""
    k, size = F.col("p_partkey") % 100, F.col("p_size")
    grid = _t(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("sheet"), (F.floor(k / 20) + 6).alias("row"), (k % 20 + 2).alias("col"), "p_name", size.alias("size"))
    header = F.when(F.col("col") % 7 == 3, F.concat(F.lit("Columna"), "col")).when((F.col("sheet") % 3 == 0) & (F.col("col") == 5), "Código").when(F.col("col") == 9, "Nombre del paquete").otherwise(F.col("p_name"))
    value = F.when(F.col("row") == 6, header).when(F.col("size") % 4 == 0, "").otherwise(F.concat("p_name", F.lit("  |")))
    sheets = grid.select("sheet").distinct()
    fixed = F.array(*[F.struct(F.lit(r).cast("long").alias("row"), F.lit(c).cast("long").alias("col"), F.lit(v).alias("value")) for r, c, v in _AROUND])
    second = F.transform(F.when(F.col("sheet") % 3 == 1, F.sequence(F.lit(2), F.lit(11))).when(F.col("sheet") % 3 == 2, F.sequence(F.lit(2), F.lit(4))), lambda c: F.struct(F.lit(5).cast("long").alias("row"), c.cast("long").alias("col"), F.lit("v").alias("value")))
    around = sheets.select("sheet", F.inline(F.concat(fixed, F.coalesce(second, F.slice(fixed, 1, 0)))))
    corners = lambda name, *at: F.struct(F.lit(name).alias("name"), *[F.lit(x).alias(c) for x, c in zip(at, ("min_row", "min_col", "max_row", "max_col"), strict=True)])
    tables = sheets.select("sheet", F.inline(F.array(corners("Base_general", 6, 2, 10, 21), corners("Tabla1", 40, 2, 42, 4))))
    even = F.when(F.col("sheet") % 2 == 0, F.array(corners("", 4, 3, 4, 6), corners("", 5, 4, 5, 5))).otherwise(F.array(corners("", 5, 4, 5, 5), corners("", 4, 22, 4, 24)))
    merges = sheets.select("sheet", F.inline(even)).drop("name")
    named = sheets.select("sheet", F.concat(F.lit("Hoja_"), "sheet").alias("name"), F.when(F.col("sheet") % 5 == 1, "hidden").otherwise("visible").alias("state"))
    return grid.select("sheet", "row", "col", value.alias("value")).unionByName(around), tables, merges, named


_SHEET = f"""
p AS (SELECT p_partkey // 100 AS sheet, p_partkey % 100 // 20 + 6 AS r, p_partkey % 20 + 2 AS c, p_name, p_size FROM part),
sheets AS (SELECT DISTINCT sheet, 'Hoja_' || sheet AS name FROM p),
raw AS (
  SELECT sheet, r, c, CASE WHEN r = 6 THEN CASE WHEN c % 7 = 3 THEN 'Columna' || c WHEN sheet % 3 = 0 AND c = 5 THEN 'Código' WHEN c = 9 THEN 'Nombre del paquete' ELSE p_name END WHEN p_size % 4 = 0 THEN '' ELSE p_name || '  |' END AS value FROM p
  UNION ALL SELECT sheet, r, c, v FROM sheets, (VALUES {", ".join(f"({r}, {c}, '{v}')" for r, c, v in _AROUND)}) a(r, c, v)
  UNION ALL SELECT sheet, 5, c, 'v' FROM sheets, range(2, 12) a(c) WHERE sheet % 3 = 1 OR sheet % 3 = 2 AND c <= 4),
f AS (SELECT * FROM (SELECT sheet, r, c, trim(regexp_replace(replace(regexp_replace(value, '<br>', ' — '), '|', '&#124;'), '\\s+', ' ', 'g')) AS said FROM raw) WHERE said <> ''),
t AS (SELECT sheet, no, title, r1, c1, r2, c2 FROM sheets, LATERAL (SELECT 1 AS no, 'Base general' AS title, 6 AS r1, 2 AS c1, 10 AS r2, 21 AS c2 UNION ALL SELECT 2, name, 40, 2, 42, 4) x),
m AS (SELECT sheet, r1, c1, r2, c2 FROM sheets, (VALUES (4, 3, 4, 6), (5, 4, 5, 5), (4, 22, 4, 24)) a(r1, c1, r2, c2) WHERE CASE WHEN sheet % 2 = 0 THEN c1 <> 22 ELSE c1 <> 3 END),
h AS (
  SELECT x.sheet, x.no, x.c, coalesce(said, chr(64 + x.c::int)) AS header FROM (SELECT sheet, no, r1, unnest(range(c1, c2 + 1)) AS c FROM t) x LEFT JOIN f ON f.sheet = x.sheet AND f.r = x.r1 AND f.c = x.c),
own AS (SELECT * FROM h WHERE no = 1 AND NOT regexp_full_match(lower(header), 's[0-9]*|x|columna[0-9]*')),
native AS (
  SELECT m.sheet, m.r1, m.c1, m.r2, m.c2, said AS title, list(own.c ORDER BY own.c) AS cols, chr(64 + m.c1) || m.r1 || ':' || chr(64 + m.c2) || m.r2 AS evidence
  FROM m JOIN f ON f.sheet = m.sheet AND f.r = m.r1 AND f.c = m.c1 JOIN own ON own.sheet = m.sheet AND own.c BETWEEN greatest(m.c1, 2) AND least(m.c2, 21) WHERE m.r2 BETWEEN 3 AND 5 GROUP BY ALL),
reach_of AS (SELECT s.sheet, coalesce(max(list_max(cols)), 1) AS last FROM sheets s LEFT JOIN native n ON n.sheet = s.sheet GROUP BY s.sheet),
late AS (
  SELECT f.sheet, f.c AS c1, said AS title, list(own.c ORDER BY own.c) AS cols, chr(64 + f.c::int) || 4 AS evidence
  FROM f JOIN reach_of USING (sheet) JOIN own ON own.sheet = f.sheet AND own.c >= f.c
  WHERE f.r = 4 AND f.c BETWEEN 2 AND 21 AND f.c > last AND length(said) >= 8 AND NOT starts_with(said, '*') GROUP BY ALL),
claimed AS (SELECT sheet, unnest(cols) AS c FROM native UNION SELECT sheet, unnest(cols) FROM late),
rest AS (SELECT sheet, c, header, (row_number() OVER (PARTITION BY sheet ORDER BY c) - 1) // 9 AS cut FROM own ANTI JOIN claimed USING (sheet, c)),
chunks AS (
  SELECT sheet, cut, list(c ORDER BY c) AS cols, CASE WHEN arg_min(header, c) = arg_max(header, c) THEN arg_min(header, c) ELSE arg_min(header, c) || ' → ' || arg_max(header, c) END AS whole FROM rest GROUP BY ALL),
groups AS (
  SELECT sheet, cols, CASE WHEN length(whole) <= 78 THEN whole ELSE rtrim(whole[:75]) || '…' END AS title, 'encabezados de la tabla' AS evidence, 0 AS kind, cut AS a, 0 AS b FROM chunks
  UNION ALL SELECT sheet, cols, title, evidence, 1, r1, c1 FROM native UNION ALL SELECT sheet, cols, title, evidence, 2, c1, 0 FROM late
  UNION ALL SELECT sheet, list(c ORDER BY c), 'Campos técnicos del libro', 'encabezados auxiliares', 3, 0, 0 FROM h ANTI JOIN own USING (sheet, no, c) WHERE no = 1 GROUP BY sheet),
parted AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY kind = 3, list_min(cols), kind, a, b) AS part FROM groups),
ranked AS (SELECT sheet, 1 AS rank, min(c) AS c FROM h WHERE no = 1 AND regexp_matches(header, '(?i)\\b(código|codigo|id|número|numero|referencia)\\b') GROUP BY sheet),
second AS (SELECT h.sheet, 2 AS rank, min(h.c) AS c FROM h LEFT JOIN ranked r ON r.sheet = h.sheet WHERE no = 1 AND h.c IS DISTINCT FROM r.c AND regexp_matches(header, '(?i)\\b(paquete|título|titulo|nombre|descripción|descripcion)\\b') GROUP BY h.sheet),
other AS (SELECT sheet, 3 AS rank, min(c) AS c FROM own WHERE sheet NOT IN (SELECT sheet FROM ranked UNION SELECT sheet FROM second) GROUP BY sheet),
keys AS (SELECT sheet, list(c ORDER BY rank) AS keys FROM (FROM ranked UNION ALL FROM second UNION ALL FROM other) GROUP BY sheet),
shown AS (SELECT p.*, keys, keys || list_filter(cols, lambda x: NOT list_contains(keys, x)) AS shown, list_filter(keys, lambda x: NOT list_contains(cols, x)) AS repeated FROM parted p JOIN keys USING (sheet)),
named AS (
  SELECT x.sheet, part, list(header ORDER BY place) AS headers FROM (SELECT sheet, part, unnest(shown) AS c, generate_subscripts(shown, 1) AS place FROM shown) x JOIN h ON h.sheet = x.sheet AND h.no = 1 AND h.c = x.c GROUP BY ALL),
taken AS (
  SELECT sheet, r1, c1, r2, c2 FROM t UNION ALL SELECT sheet, r1, c1, r2, c2 FROM native UNION ALL SELECT sheet, 4, c1, 4, c1 FROM late
  UNION ALL SELECT sheet, 5, 2, 5, 21 FROM f WHERE r = 5 AND c BETWEEN 2 AND 21 GROUP BY sheet HAVING count(*) >= 7),
free AS (SELECT sheet, r, c, said, r * 100 + c AS id FROM f WHERE NOT EXISTS (SELECT 1 FROM taken x WHERE x.sheet = f.sheet AND r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2)),
reach AS (SELECT sheet, r, c, said, id FROM free UNION SELECT f.sheet, f.r, f.c, f.said, x.id FROM reach x JOIN free f ON f.sheet = x.sheet AND abs(f.r - x.r) + abs(f.c - x.c) = 1),
label AS (SELECT sheet, r, c, said, min(id) AS region FROM reach GROUP BY ALL),
box AS (SELECT sheet, region, min(r) AS r1, min(c) AS c1, max(r) AS r2, max(c) AS c2, count(*) AS n, list(said ORDER BY r, c) AS texts FROM label GROUP BY ALL),
boxes AS (SELECT *, chr(64 + c1::int) || r1 || ':' || chr(64 + c2::int) || r2 AS ref FROM box),
blocks AS (
  SELECT sheet, 0 AS rank, 0 AS at_row, 0 AS at_col, 0 AS part, 'notes' AS kind, 'Notas y controles del archivo' AS title, NULL AS source_ref, 'alta' AS confidence, NULL AS evidence,
         NULL::bigint[] AS columns, NULL::varchar[] AS headers, NULL::bigint[] AS repeated, list('`' || ref || '` — ' || texts[1] ORDER BY r1, c1) AS items, NULL AS first_row, NULL AS last_row FROM boxes WHERE n = 1 GROUP BY sheet
  UNION ALL SELECT t.sheet, 1, r1, c1, 0, 'table', title, 'B40:D42', 'alta', 'tabla nativa del XLSX', [2, 3, 4], list(header ORDER BY c), [], NULL, 41, 42 FROM t JOIN h ON h.sheet = t.sheet AND h.no = 2 WHERE t.no = 2 GROUP BY ALL
  UNION ALL SELECT sheet, 1, r1, c1, 0, 'table_group', title, 'B6:U10', 'alta', NULL, range(2, 22), NULL, NULL, NULL, 7, 10 FROM t WHERE no = 1
  UNION ALL SELECT sheet, 1, 6, 2, part, 'table', title, chr(64 + list_min(cols)::int) || 6 || ':' || chr(64 + list_max(cols)::int) || 10, CASE WHEN kind = 0 THEN 'media' ELSE 'alta' END, evidence,
         shown, headers, repeated, NULL, 7, 10 FROM shown JOIN named USING (sheet, part)
  UNION ALL SELECT sheet, 2, r1, c1, 0, 'list', 'Lista ' || ref, ref, 'media', NULL, [c1], NULL, NULL, texts, r1, r2 FROM boxes WHERE n > 1 AND c1 = c2
  UNION ALL SELECT sheet, 2, r1, c1, 0, 'table', 'Bloque ' || ref, ref, 'media', 'región continua de celdas', range(c1, c2 + 1), list_transform(range(c1, c2 + 1), lambda x: chr(64 + x::int)), [], NULL, r1, r2 FROM boxes WHERE c2 > c1)
"""


def _flat(blocks):
    """Blocks with their arrays as texts."""
    lists = {c: F.array_join(F.col(c).cast("array<string>"), " / ") for c in ("columns", "headers", "repeated", "items")}
    return blocks.withColumns(lists)


@query(rf"""
WITH RECURSIVE {_SHEET}
SELECT sheet, dense_rank() OVER (PARTITION BY sheet ORDER BY rank, at_row, at_col) AS nth, part, kind, title, source_ref, confidence, evidence, array_to_string(columns, ' / ') AS columns,
       array_to_string(headers, ' / ') AS headers, array_to_string(repeated, ' / ') AS repeated, array_to_string(items, ' / ') AS items, first_row, last_row
FROM blocks
""")
def structure_sheet(spark, sf_dir):
    return _flat(X.structure(*_sheet(spark, sf_dir)))


@query(rf"""
WITH RECURSIVE {_SHEET},
b AS (SELECT *, dense_rank() OVER (PARTITION BY sheet ORDER BY rank, at_row, at_col) AS nth FROM blocks),
lines AS (
  SELECT sheet, nth, part, 0 AS place, 0 AS r, CASE WHEN part > 0 THEN '#### ' ELSE '### ' END || title AS line FROM b
  UNION ALL SELECT sheet, nth, part, x, 0, '' FROM b, (VALUES (1), (1001)) v(x)
  UNION ALL SELECT sheet, nth, part, 2, 0, '> Tabla original de 20 columnas (`' || source_ref || '`). Se divide para lectura; los identificadores se repiten y ninguna columna se descarta.' FROM b WHERE kind = 'table_group'
  UNION ALL SELECT sheet, nth, part, 2, 0, '*Fuente: `' || source_ref || '` · confianza ' || confidence || CASE WHEN len(repeated) > 0 THEN ' · columnas de identificación repetidas para lectura' ELSE '' END || '.*' FROM b WHERE kind = 'table'
  UNION ALL SELECT sheet, nth, part, 3, 0, '' FROM b WHERE kind = 'table'
  UNION ALL SELECT sheet, nth, part, 4, 0, '| ' || array_to_string(list_transform(list_zip(headers, columns), lambda x: CASE WHEN x[1] = chr(64 + x[2]::int) THEN x[1] ELSE x[1] || ' [' || chr(64 + x[2]::int) || ']' END), ' | ') || ' |' FROM b WHERE kind = 'table'
  UNION ALL SELECT sheet, nth, part, 5, 0, '| ' || array_to_string(list_transform(headers, lambda x: '---'), ' | ') || ' |' FROM b WHERE kind = 'table'
  UNION ALL SELECT sheet, nth, part, 5 + i, 0, '- ' || item FROM (SELECT sheet, nth, part, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM b)
  UNION ALL
  SELECT sheet, nth, part, 1000, r, '| ' || string_agg(value, ' | ' ORDER BY place) || ' |' FROM (
    SELECT x.sheet, x.nth, x.part, x.r, x.place, coalesce(replace(w.value, '|', '&#124;'), '') AS value
    FROM (SELECT *, unnest(range(first_row, last_row + 1)) AS r FROM (SELECT sheet, nth, part, unnest(columns) AS c, generate_subscripts(columns, 1) AS place, first_row, last_row FROM b WHERE kind = 'table')) x
    LEFT JOIN raw w ON w.sheet = x.sheet AND w.r = x.r AND w.c = x.c AND trim(w.value) <> '')
  GROUP BY ALL HAVING bool_or(value <> '')),
bodies AS (SELECT sheet, string_agg(line, chr(10) ORDER BY nth, part, place, r) AS body FROM lines GROUP BY sheet),
stats AS (SELECT sheet, count(DISTINCT r) AS n_rows, count(DISTINCT c) AS n_cols, count(*) AS n, chr(64 + min(c)::int) || min(r) || ':' || chr(64 + max(c)::int) || max(r) AS used FROM raw WHERE trim(value) <> '' GROUP BY sheet)
SELECT sheet, sheet % 5 = 1 AS hidden, '## Hoja: Hoja_' || sheet || CASE WHEN sheet % 5 = 1 THEN ' *(oculta)*' ELSE '' END || chr(10) || 'filas ' || n_rows || ' · columnas con dato ' || n_cols || ' · 2 tablas nativas' || chr(10) || chr(10)
       || '> Rango usado `' || used || '` · ' || n || ' celdas con dato.' || chr(10) || chr(10) || body AS markdown
FROM bodies JOIN stats USING (sheet)
""")
def structure_sections(spark, sf_dir):
    cells, tables, merges, sheets = _sheet(spark, sf_dir)
    return X.sheet_sections(X.structure(cells, tables, merges, sheets), cells, sheets)
