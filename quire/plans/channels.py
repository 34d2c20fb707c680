"""Queries of the channels of Word and slides over archives of the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import sheets as S
from quire.sources import channels, decks, office

from . import samples
from .packages import _t, query

_PARTS = "p AS (SELECT '/in/' || p_partkey // 20 || '.docx' AS path, p_partkey % 20 AS k, p_partkey, p_name, p_size FROM part)"
_SLIDES = "s AS (SELECT '/in/' || o_orderkey // 40 || '.pptx' AS path, o_orderkey % 40 + 1 AS slide, * FROM orders)"


def _word(spark, sf_dir):
    return office.unpacked(samples.word_margins(_t(spark, sf_dir, "part")), "^word/")


def _decks(spark, sf_dir):
    return samples.decks(_t(spark, sf_dir, "orders"))


@query(f"""
WITH {_PARTS}
SELECT path, 'footnote' AS channel, k AS id, NULL AS author, 'note ' || p_name AS text FROM p
UNION ALL SELECT path, 'comment', k, 'A' || p_size, 'first' || chr(10) || p_size FROM p WHERE p_size % 3 = 0
UNION ALL SELECT DISTINCT path, 'header', NULL, NULL, 'head ' || path FROM p
""")
def word_channels(spark, sf_dir):
    return channels.word_channels(_word(spark, sf_dir)).select("path", "channel", "id", "author", "text")


@query(f"""
WITH {_PARTS}
SELECT path, row_number() OVER (PARTITION BY path ORDER BY k) AS nth, 'see & ' || p_size AS text, CASE WHEN k % 4 = 0 THEN '#a' || p_size ELSE 'https://x/' || p_partkey END AS target FROM p
""")
def word_links(spark, sf_dir):
    return channels.word_links(_word(spark, sf_dir))


@query(f"""
WITH {_PARTS}
SELECT path, row_number() OVER (PARTITION BY path ORDER BY k) AS nth, CASE WHEN p_size % 2 = 0 THEN '(' || p_size || ')/(x^(' || k || '))' ELSE '√([a,' || p_size || '))' END AS text FROM p
""")
def word_formulas(spark, sf_dir):
    return channels.word_formulas(_word(spark, sf_dir))


@query(f"""
WITH {_SLIDES}
SELECT path, slide, 1 AS table_no, 1 AS row_no, 1 AS col, 'c' || o_custkey AS text FROM s UNION ALL SELECT path, slide, 1, 1, 2, '' FROM s
UNION ALL SELECT path, slide, 1, 2, 1, o_orderstatus || chr(10) || 'a<bA' FROM s UNION ALL SELECT path, slide, 1, 2, 2, o_orderpriority FROM s
""")
def slide_tables(spark, sf_dir):
    return channels.deck_tables(_decks(spark, sf_dir))


@query(f"""
WITH {_SLIDES}
SELECT path, slide, 'say ' || o_custkey || chr(10) || ' ' || chr(10) || o_orderstatus AS text, '> **Notas del orador:** say ' || o_custkey || chr(10) || '>' || chr(10) || '> ' || o_orderstatus AS quoted FROM s WHERE o_orderkey % 5 <> 0
""")
def slide_notes(spark, sf_dir):
    return channels.deck_notes(_decks(spark, sf_dir))


@query(r"""
WITH p AS (SELECT '/in/' || p_partkey // 20 || '.docx' AS path, (row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey))::varchar AS n, p_partkey, p_name, p_size, chr(10) AS nl FROM part),
inner_ AS (SELECT * FROM p WHERE p_size % 3 <> 0)
SELECT path, n AS label, NULL AS parent, 1 AS row_no, 1 AS col, p_name || CASE WHEN p_size % 3 <> 0 THEN nl || '[tabla anidada ' || n || '.1]' ELSE '' END AS text FROM p
UNION ALL SELECT path, n, NULL, 1, 2, p_size::varchar FROM p
UNION ALL SELECT path, n || '.1', n, 1, c, 'i-' || p_size FROM inner_, (VALUES (1), (2)) v(c)
UNION ALL SELECT path, n || '.1', n, r, 1, 'm' || p_size FROM inner_, (VALUES (2), (3)) v(r)
UNION ALL SELECT path, n || '.1', n, 2, 2, 'x' || nl || 'y' FROM inner_
UNION ALL SELECT path, n || '.1', n, 3, 2, CASE WHEN p_size % 2 = 0 THEN '[tabla anidada ' || n || '.1.1]' ELSE '' END FROM inner_
UNION ALL SELECT path, n || '.1.1', n || '.1', 1, 1, 'deep' || p_partkey FROM inner_ WHERE p_size % 2 = 0
""")
def word_nested_tables(spark, sf_dir):
    return office.word_grids(office.members(samples.nested_word_files(_t(spark, sf_dir, "part")), "^word/"))


_LISTED = "s AS (SELECT '/in/' || o_orderkey // 40 || '.pptx' AS path, row_number() OVER (PARTITION BY o_orderkey // 40 ORDER BY o_orderkey DESC) AS slide, * FROM orders)"


@query(f"""
WITH {_LISTED}
SELECT path, slide, 2 AS shape_id, 0 AS depth, 'c' || o_custkey AS text, o_orderkey % 7 = 0 AS hidden FROM s
UNION ALL SELECT path, slide, 5, 2, o_orderpriority, o_orderkey % 7 = 0 FROM s
""")
def slide_order(spark, sf_dir):
    found = office.unpacked(samples.listed_decks(_t(spark, sf_dir, "orders")), "^ppt/")
    return office.slide_shapes(found).select("path", "slide", "shape_id", F.size("groups").alias("depth"), "text", "hidden")


@query(f"WITH {_LISTED} SELECT path, slide, 'c' || o_custkey || ' → ' || o_orderpriority AS edge FROM s")
def grouped_edges(spark, sf_dir):
    edges = decks.slide_edges(samples.listed_decks(_t(spark, sf_dir, "orders")))
    return edges.select("path", "slide", S.edge_text().alias("edge"))


@query("""
SELECT '/in/' || p_partkey AS path, NULL AS member, CASE WHEN p_partkey % 6 = 1 THEN 'repeated names' ELSE 'damaged' END AS fault, NULL AS bytes FROM part WHERE p_partkey % 6 > 0
UNION ALL SELECT '/in/' || p_partkey, 'a.xml', NULL, strlen(p_name) + 7 FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT '/in/' || p_partkey, 'b.xml', NULL, 4 FROM part WHERE p_partkey % 6 = 0
""")
def archive_guard(spark, sf_dir):
    """What is opened and what is refused; a refused archive is one row."""
    return office.members(samples.odd_archives(_t(spark, sf_dir, "part"))).select("path", "member", "fault", F.octet_length("content").alias("bytes"))
