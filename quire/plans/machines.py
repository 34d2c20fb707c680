"""Queries of swapped tables, recovered places and items' machines, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.session import shared_dir
from quire.sources import swaps
from quire.streaming import machine

from .packages import _t, query


def _place(spark, name):
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


@query("SELECT 'failed' AS moment, doc_id, n_chars FROM documents UNION ALL SELECT 'published', doc_id, n_chars + 1 FROM documents")
def swap_read(spark, sf_dir):
    """What a reader sees after a write that failed halfway, and after the one that followed it."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    table = swaps.Swap(spark, _place(spark, "swap"), StructType.fromDDL("doc_id long, n_chars long"), "doc_id")
    first = table.replace(docs, table.current())
    try:
        table.replace(docs.withColumn("n_chars", F.when(F.col("doc_id") % 97 == 5, F.raise_error(F.lit("no more room")).cast("long")).otherwise(F.lit(0).cast("long"))), first)
    except PySparkException:
        pass
    failed = table.read()
    table.replace(docs.withColumn("n_chars", F.col("n_chars") + 1), table.current())
    return failed.select(F.lit("failed").alias("moment"), "*").unionByName(table.read().select(F.lit("published").alias("moment"), "*"))


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS id FROM documents),
k AS (SELECT id, bool_or(doc_id % 3 = 0) AS intact, max(CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 0 END) + max(CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END) AS times FROM d GROUP BY id)
SELECT id AS package_id, CASE WHEN intact THEN 'reuse' WHEN times > 0 THEN 'recover' ELSE 'publish' END AS action,
       CASE WHEN intact OR times = 0 THEN id ELSE id || '-recuperado-' || sha256(id || '|' || times)[:8] END AS output
FROM k
""")
def package_places(spark, sf_dir):
    """A third of the packages is intact in the catalog; half have a folder, a quarter one that was recovered before."""
    d, k = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("package_id")), F.col("doc_id")
    catalog = d.select("package_id", F.col("package_id").alias("output"), (k % 3 == 0).alias("integrity_ok"))
    folders = d.filter(k % 4 < 2).select(F.col("package_id").alias("output")).unionByName(d.filter(k % 4 == 1).select(F.concat("package_id", F.lit("-recuperado-0123abcd")).alias("output")))
    return swaps.placed_packages(d, catalog, folders)


_SAID = {"view": "start", "click": "finish", "error": "fail", "purchase": "retry", "signup": "interrupt"}
_FOLD = """list_reduce({events}, lambda s, e: CASE WHEN MAP {{'listo start': 'en_curso', 'en_curso finish': 'terminado', 'en_curso fail': 'error', 'en_curso interrupt': 'listo', 'error retry': 'en_curso'}}[split_part(s, '|', 1) || ' ' || e] IS NULL
  THEN split_part(s, '|', 1) || '|' || split_part(s, '|', 2) || '|' || (split_part(s, '|', 3)::bigint + 1)
  ELSE MAP {{'listo start': 'en_curso', 'en_curso finish': 'terminado', 'en_curso fail': 'error', 'en_curso interrupt': 'listo', 'error retry': 'en_curso'}}[split_part(s, '|', 1) || ' ' || e] || '|' || (split_part(s, '|', 2)::bigint + 1) || '|' || split_part(s, '|', 3) END, {begin})"""
_MACHINE = f"""
e AS (SELECT event_id, user_id || '#' || event_id % 10 AS item, user_id % 5 = 0 AS out, event_id < (SELECT max(event_id) // 2 FROM events) AS first,
      MAP {{{", ".join(f"'{a}': '{b}'" for a, b in _SAID.items())}}}[event_type] AS event FROM events),
i AS (SELECT item, out, coalesce(list(event ORDER BY event_id) FILTER (first), []) AS a, coalesce(list(event ORDER BY event_id) FILTER (NOT first), []) AS b FROM e GROUP BY item, out),
one AS (SELECT *, {_FOLD.format(events="a", begin="CASE WHEN out THEN 'pendiente' ELSE 'listo' END || '|0|0'")} AS s FROM i),
two AS (SELECT *, split_part(s, '|', 1) = 'en_curso' AS was_running, {_FOLD.format(events="b", begin="replace(s, 'en_curso', 'listo')")} AS t FROM one),
items AS (SELECT item, split_part(t, '|', 1) AS state, split_part(t, '|', 2)::bigint AS steps, split_part(t, '|', 3)::bigint AS refused, was_running::bigint AS resumed FROM two)
"""


def _machine(spark, sf_dir):
    """Events of two runs, an item's events of a run in one file; a fifth of the items is pendiente."""
    said = F.create_map(*[F.lit(x) for pair in _SAID.items() for x in pair])
    events = _t(spark, sf_dir, "events").select(F.concat_ws("#", "user_id", F.col("event_id") % 10).alias("item"), F.col("event_id").alias("seq"), said[F.col("event_type")].alias("event"), "user_id")
    half = events.agg(F.floor(F.max("seq") / 2).alias("h")).first()["h"]
    base = _place(spark, "machine")
    made = machine.Machine(spark, f"{base}/state")
    made.plan(events.select("item", F.when(F.col("user_id") % 5 == 0, "pendiente").otherwise("listo").alias("state")))
    schema = events.drop("user_id").schema
    for run in (events.filter(F.col("seq") < half), events.filter(F.col("seq") >= half)):
        run.select(*schema.names).repartition(3, "item").write.mode("append").parquet(f"{base}/in")
        made.run(f"{base}/in", schema, 2)
    return made


@query(f"WITH {_MACHINE} SELECT * FROM items")
def item_machine(spark, sf_dir):
    return _machine(spark, sf_dir).items().drop("last")


@query(f"WITH {_MACHINE} SELECT count(*) FILTER (state IN ('terminado', 'error')) AS done, count(*) AS total FROM items WHERE state <> 'pendiente'")
def item_progress(spark, sf_dir):
    return _machine(spark, sf_dir).progress().drop("version")
