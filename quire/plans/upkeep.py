"""Queries of deletion and repair over a library made of the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import upkeep as U

from .packages import _t, query


def _library(spark, sf_dir):
    """A package a document: catalog, folders (some gone, some damaged, some without a row) and batches that point to two of them."""
    k, ident = F.col("doc_id"), F.sha2(F.col("doc_id").cast("string"), 256)
    d = _t(spark, sf_dir, "documents").select(k.alias("k"), ident.alias("doc_id"), F.concat(F.lit("t"), k % 10).alias("title"), F.lit("ok").alias("status"), (k % 9 > 0).alias("integrity_ok"), F.lit(1).alias("received"), F.lit(1).alias("expected"), F.lit(0).alias("warnings"))
    k = F.col("k")
    catalog = d.filter(k % 6 > 0)
    folders = d.filter(k % 5 > 0)
    batches = d.select(k.alias("batch"), F.col("doc_id").alias("source"), F.when(k % 2 == 0, F.sha2((k + 1).cast("string"), 256)).alias("output"))
    return d, catalog, folders, batches


_LIBRARY = """
d AS (SELECT doc_id AS k, sha256(doc_id::varchar) AS id, 't' || doc_id % 10 AS title, doc_id % 9 > 0 AS fine FROM documents),
b AS (SELECT k AS batch, id AS a, CASE WHEN k % 2 = 0 THEN k + 1 END AS other FROM d)
"""


@query(f"""
WITH {_LIBRARY},
gone AS (SELECT k, id FROM d WHERE k % 6 > 0 AND k % 4 = 0 AND NOT (k % 7 = 0 AND k % 5 > 0)),
good AS (SELECT k FROM d WHERE k % 6 > 0 AND k % 5 > 0 AND fine AND k NOT IN (SELECT k FROM gone))
SELECT 1 AS step, 'check' AS action, id, 'failed' AS outcome, CASE WHEN k % 6 = 0 THEN 'not in the catalog' ELSE 'the folder stays' END AS reason FROM d WHERE k % 4 = 0 AND k NOT IN (SELECT k FROM gone)
UNION ALL SELECT 1, 'check', 'x' || k, 'failed', 'no identity' FROM d WHERE k % 50 = 0
UNION ALL SELECT 2, 'discard_folder', id, 'done', NULL FROM gone WHERE k % 5 > 0
UNION ALL SELECT 3, 'delete_rows', id, 'done', NULL FROM gone
UNION ALL SELECT 4, 'purge_batch', batch::varchar, 'done', NULL FROM b WHERE (batch NOT IN (SELECT k FROM good) OR other IS NOT NULL AND other NOT IN (SELECT k FROM good)) AND EXISTS (SELECT 1 FROM gone)
UNION ALL SELECT 5, 'write_index', 'index', 'done', NULL WHERE EXISTS (SELECT 1 FROM gone)
""")
def deletion_steps(spark, sf_dir):
    d, catalog, folders, batches = _library(spark, sf_dir)
    as_output = lambda x: x.withColumn("output", F.col("doc_id"))
    asked = d.filter("k % 4 = 0").select("doc_id").unionByName(d.filter("k % 50 = 0").select(F.concat(F.lit("x"), "k").alias("doc_id")))
    kept = d.filter("k % 7 = 0").select(F.col("doc_id").alias("output"))
    steps, _ = U.delete(asked, as_output(catalog), as_output(folders).select("output", "integrity_ok"), kept, batches)
    return steps


@query(f"""
WITH {_LIBRARY},
good AS (SELECT k FROM d WHERE k % 5 > 0 AND fine)
SELECT 1 AS step, 'prune' AS action, id, 'done' AS outcome, NULL AS reason FROM d WHERE k % 6 > 0 AND k % 5 = 0
UNION ALL SELECT 2, 'adopt', id, 'done', NULL FROM d WHERE k % 6 = 0 AND k % 5 > 0 AND fine
UNION ALL SELECT 3, 'damaged', id, 'reported', NULL FROM d WHERE k % 6 > 0 AND k % 5 > 0 AND NOT fine
UNION ALL SELECT 4, 'purge_batch', batch::varchar, 'done', NULL FROM b WHERE batch NOT IN (SELECT k FROM good) OR other IS NOT NULL AND other NOT IN (SELECT k FROM good)
UNION ALL SELECT 5, 'write_index', 'index', 'done', NULL
""")
def repair_steps(spark, sf_dir):
    _, catalog, folders, batches = _library(spark, sf_dir)
    return U.repair(catalog, folders, batches)[0]


@query(f"""
WITH {_LIBRARY}
SELECT title, id AS doc_id, '- [' || title || '](<documentos/' || id || '/documento.md>) — **ok**, ' || CASE WHEN fine THEN '1/1 unidades; 0 avisos' ELSE 'integridad dañada' END || '.' AS line
FROM d WHERE k % 5 > 0 AND (k % 6 > 0 OR fine)
""")
def repaired_index(spark, sf_dir):
    _, catalog, folders, batches = _library(spark, sf_dir)
    return U.index_of(U.repair(catalog, folders, batches)[1])
