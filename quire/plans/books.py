"""Queries of books, CSV files and workbooks' layers over files made of the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.sources import books, office

from . import samples
from .packages import _t, query


@query("""
WITH o AS (SELECT '/in/' || o_orderkey // 40 || '.epub' AS path, row_number() OVER (PARTITION BY o_orderkey // 40 ORDER BY o_orderkey DESC) AS position, * FROM orders),
b AS (SELECT path, position, unnest([1, 2, 3]) AS own, unnest(['heading', 'paragraph', 'list']) AS kind, unnest([2, NULL, NULL]) AS level, unnest(['c' || o_custkey, o_orderpriority || ' & ' || o_orderkey, 'i' || o_orderstatus]) AS text FROM o)
SELECT path, position, row_number() OVER (PARTITION BY path ORDER BY position, own) AS block_no, kind, level, text FROM b
""")
def book_blocks(spark, sf_dir):
    return books.book_blocks(office.unpacked(samples.epubs(_t(spark, sf_dir, "orders")), "\\.(xml|opf|xhtml)$"))


@query("""
WITH c AS (SELECT '/in/' || p_partkey // 30 || '.csv' AS path, CASE p_partkey // 30 % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS separator,
                  row_number() OVER (PARTITION BY p_partkey // 30 ORDER BY p_partkey) AS row_no, * FROM part)
SELECT path, separator, row_no, p_partkey || '/' || 'a "b"' || separator || chr(10) || p_name || '/' || p_size AS cells FROM c
""")
def csv_rows(spark, sf_dir):
    return books.csv_rows(samples.csv_files(_t(spark, sf_dir, "part"))).select("path", "separator", "row_no", F.array_join("cells", "/").alias("cells"))


@query("""
WITH p AS (SELECT '/in/' || p_partkey // 40 || '.xlsx' AS path, p_partkey % 40 + 1 AS r, p_size FROM part)
SELECT path, 'B' || r AS cell, 'A' || r || '*2+$A$1+SUM(A' || r || ':C' || (r + 1) || ')' AS formula, CASE WHEN p_size % 3 = 0 THEN '[SIN CACHÉ] A' || r || '*2+$A$1+SUM(A' || r || ':C' || (r + 1) || ')' ELSE (p_size * 2)::varchar END AS value FROM p
UNION ALL SELECT path, 'A' || r, NULL, p_size::varchar FROM p
""")
def shared_formulas(spark, sf_dir):
    return office.workbook_cells(office.unpacked(samples.shared_books(_t(spark, sf_dir, "part")), "^xl/.*\\.(xml|rels)$")).select("path", "cell", "formula", "value")


@query("""
WITH p AS (SELECT p_partkey // 40 AS b, count(*) AS n FROM part GROUP BY 1)
SELECT '/in/' || b || '.xlsx' AS path, 'merge' AS kind, NULL AS name, 1 AS min_row, 1 AS min_col, 1 AS max_row, 3 AS max_col FROM p
UNION ALL SELECT '/in/' || b || '.xlsx', 'table', 'Tabla_' || b, 2, 1, n + 2, 2 FROM p
""")
def workbook_ranges(spark, sf_dir):
    found = office.unpacked(samples.shared_books(_t(spark, sf_dir, "part")), "^xl/.*\\.(xml|rels)$")
    corners = ("min_row", "min_col", "max_row", "max_col")
    merges = office.workbook_merges(found).select("path", F.lit("merge").alias("kind"), F.lit(None).cast("string").alias("name"), *corners)
    return merges.unionByName(office.workbook_tables(found).select("path", F.lit("table").alias("kind"), "name", *corners))
