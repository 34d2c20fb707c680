"""Queries of named exports in two runs over documents made of the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import exports as E
from quire.session import settled

from .packages import _t, query


def _runs(spark, sf_dir):
    """Two runs of an export of parts: between them a fifth of the files is edited, a seventh deleted, and two thirds of the texts change."""
    k = F.col("p_partkey")
    text = lambda changed: F.concat(F.lit("# "), "p_name", F.lit("\n[c](document.json) ![i](<imagenes/u 1.png>) "), k.cast("string"), F.when(k % 3 > 0, changed).otherwise(""))
    docs = lambda changed: _t(spark, sf_dir, "part").select(
        k.alias("doc_id"), F.concat(F.lit("s"), k).alias("source_id"), F.concat(F.lit("T "), F.floor(k / 10).cast("string")).alias("title"), text(changed).alias("text"), F.array(F.lit("document.json"), F.lit("imagenes/u 1.png")).alias("names"),
        F.concat(F.lit("../documentos/"), k.cast("string")).alias("base"), (k % 11 > 0).alias("integrity_ok"),
    )
    none = spark.createDataFrame([], "target string, source_id string, sha256 string")
    first = settled(E.plan_exports(docs(""), none, none.select("target", "sha256")), "exports")
    registry = E.exported(first, none)
    edited = F.when(F.col("doc_id") % 5 == 0, T.sha256(F.col("target"))).otherwise(F.col("sha256"))
    disk = first.filter("target IS NOT NULL AND doc_id % 7 > 0").select("target", edited.alias("sha256"))
    return first, E.plan_exports(docs("changed"), registry, disk)


_EXPORTS = """
d AS (SELECT p_partkey AS k, p_partkey // 10 AS g, p_name, p_partkey % 11 > 0 AS fine FROM part),
one AS (SELECT *, CASE WHEN fine THEN row_number() OVER (PARTITION BY g, fine ORDER BY k) END AS slot FROM d),
free AS (SELECT g, slot, row_number() OVER (PARTITION BY g ORDER BY slot) AS nth FROM (
  SELECT g, slot FROM one WHERE fine AND k % 7 = 0 UNION ALL SELECT DISTINCT g, unnest(range(n + 1, n + 11)) FROM (SELECT g, count(*) FILTER (fine) AS n FROM d GROUP BY g))),
two AS (
  SELECT *, CASE WHEN NOT fine THEN 'damaged' WHEN k % 7 = 0 OR k % 5 = 0 THEN 'create' WHEN k % 3 = 0 THEN 'unchanged' ELSE 'overwrite' END AS action,
         row_number() OVER (PARTITION BY g, fine AND (k % 7 = 0 OR k % 5 = 0) ORDER BY k) AS nth FROM one),
placed AS (SELECT two.*, CASE WHEN action = 'create' THEN free.slot ELSE two.slot END AS num FROM two LEFT JOIN free ON two.action = 'create' AND free.g = two.g AND free.nth = two.nth),
named AS (
  SELECT k AS doc_id, action, CASE WHEN fine THEN 'T ' || g || CASE WHEN num > 1 THEN ' (' || num || ')' ELSE '' END || '.md' END AS target,
         CASE WHEN fine THEN '# ' || p_name || chr(10) || '[c](<../documentos/' || k || '/document.json>) ![i](<../documentos/' || k || '/imagenes/u%201.png>) ' || k || CASE WHEN k % 3 > 0 THEN 'changed' ELSE '' END END AS content FROM placed)
"""


@query(f"WITH {_EXPORTS} SELECT doc_id, action, target, content, sha256(content) AS sha256 FROM named")
def named_exports(spark, sf_dir):
    _, second = _runs(spark, sf_dir)
    return second.select("doc_id", "action", "target", "content", "sha256")


@query(f"""
WITH {_EXPORTS},
first AS (SELECT k, 'T ' || g || CASE WHEN slot > 1 THEN ' (' || slot || ')' ELSE '' END || '.md' AS target,
          sha256('# ' || p_name || chr(10) || '[c](<../documentos/' || k || '/document.json>) ![i](<../documentos/' || k || '/imagenes/u%201.png>) ' || k) AS sha256 FROM one WHERE fine),
wrote AS (SELECT target, 's' || doc_id AS source_id, sha256(content) AS sha256 FROM named WHERE action IN ('create', 'overwrite'))
SELECT * FROM wrote UNION ALL SELECT target, 's' || k, sha256 FROM first WHERE target NOT IN (SELECT target FROM wrote)
""")
def export_registry(spark, sf_dir):
    first, second = _runs(spark, sf_dir)
    none = spark.createDataFrame([], "target string, source_id string, sha256 string")
    return E.exported(second, E.exported(first, none))
