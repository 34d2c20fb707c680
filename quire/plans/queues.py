"""Queries of queues, runs, listings and reports over the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import library as L
from quire.operators import queues as Q
from quire.session import shared_dir
from quire.sources import listings

from .packages import _ITEMS, _items, _t, query

_ENTRIES = """
e AS (SELECT l_orderkey AS queue, CASE WHEN l_partkey % 41 = 0 THEN '' ELSE 'f' || l_partkey % 30 END AS path, CASE WHEN l_suppkey % 43 > 0 THEN 'n' END AS name,
             list_extract(['listo', 'requiere_paginas', 'pendiente', 'en_nube', 'otro'], l_partkey % 5 + 1) AS status, CASE WHEN l_suppkey % 47 = 0 THEN -1 ELSE l_partkey END AS bytes,
             CASE WHEN l_partkey % 3 = 0 THEN 'o' WHEN l_partkey % 3 = 1 THEN '' END AS output FROM lineitem)
"""


def _entries(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    status = F.get(F.array(*map(F.lit, ("listo", "requiere_paginas", "pendiente", "en_nube", "otro"))), (p % 5).cast("int"))
    return _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("queue"), F.when(p % 41 == 0, "").otherwise(F.concat(F.lit("f"), p % 30)).alias("path"), F.when(s % 43 > 0, "n").alias("name"), F.lit("md").alias("format"),
        status.alias("status"), F.lit("a").alias("action"), F.when(s % 47 == 0, -1).otherwise(p).alias("bytes"), F.when(p % 3 == 0, "o").when(p % 3 == 1, "").alias("output"),
    )


@query(f"""
WITH {_ENTRIES},
p AS (SELECT queue, count(*) AS n, count(*) FILTER (path = '' OR name IS NULL OR bytes < 0) AS bad, CASE WHEN path = '' THEN 0 ELSE count(*) - 1 END AS again FROM e GROUP BY queue, path)
SELECT queue, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(bad) AS BIGINT) AS invalid, CAST(sum(again) AS BIGINT) AS repeated, sum(bad) + sum(again) = 0 AS accepted FROM p GROUP BY queue
""")
def queue_contract(spark, sf_dir):
    return Q.queue_contract(_entries(spark, sf_dir))


@query(f"""
WITH {_ENTRIES}
SELECT queue, count(*) AS total, count(*) FILTER (status IN ('listo', 'requiere_paginas')) AS ready, count(*) FILTER (output = 'o') AS completed, count(*) FILTER (status IN ('pendiente', 'en_nube')) AS pending FROM e GROUP BY queue
""")
def queue_summary(spark, sf_dir):
    return Q.queue_summary(_entries(spark, sf_dir))


@query("""
SELECT event_id AS id, event_type AS status, user_id AS reported_tokens, 'run-' || user_id AS run_folder,
       CASE WHEN event_id % 3 > 0 AND event_id % 5 > 0 THEN sha256(CAST(event_id AS VARCHAR)) || CASE WHEN event_id % 2 = 0 THEN '-recuperado-0123abcd' ELSE '' END END AS output
FROM events
""")
def results_told(spark, sf_dir):
    """Results with paths of two systems, some of no package, and columns that no listing may tell."""
    i = F.col("event_id")
    place = F.when(i % 7 == 0, F.lit("/mem/documentos/")).otherwise(F.lit("C:\\mem\\documentos\\"))
    name = F.concat(T.sha256(i), F.when(i % 2 == 0, "-recuperado-0123abcd").otherwise(""), F.when(i % 5 == 0, "x").otherwise(""))
    results = _t(spark, sf_dir, "events").select(
        i.alias("id"), F.col("event_type").alias("status"), F.col("user_id").alias("reported_tokens"), F.when(i % 3 > 0, F.concat(place, name)).alias("output"), F.concat(F.lit("/tmp/runs/run-"), "user_id", F.lit("/")).alias("run_folder"),
        F.lit("/home/key").alias("key_path"), F.col("value").alias("raw"),
    )
    return Q.told_results(results)


@query("""
SELECT p_partkey AS package, list_extract(['document.json', 'documento.md', 'verificacion.json', 'manifest.json'], p_partkey % 7 + 1) AS name FROM part WHERE p_partkey % 7 < 4
""")
def refused_assets(spark, sf_dir):
    names = F.array(*map(F.lit, ("document.json", "documento.md", "verificacion.json", "manifest.json", "a.png", "manifest.json.png", None)))
    packages = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("package"), F.array(F.concat("p_name", F.lit(".png")), F.get(names, (F.col("p_partkey") % 7).cast("int"))).alias("assets"))
    return Q.refused_assets(packages).select("package", F.explode("names").alias("name"))


@query("""
WITH p AS (SELECT o_orderkey AS id, 's' || o_custkey % 40 AS signature, o_orderkey * 7 % 1000 AS updated FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 13 > 0),
n AS (SELECT signature, id, row_number() OVER (PARTITION BY signature ORDER BY updated DESC, id DESC) AS nth FROM p)
SELECT a.signature, id AS package FROM (SELECT DISTINCT 's' || p_size AS signature FROM part) a LEFT JOIN n ON a.signature = n.signature AND nth = 1
""")
def engine_cache(spark, sf_dir):
    k = F.col("o_orderkey")
    packages = _t(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 40).alias("signature"), (k * 7 % 1000).alias("updated"), (k % 11 > 0).alias("integrity_ok"), F.when(k % 13 == 0, 32_000_001).otherwise(1000).alias("bytes"))
    return Q.cached_engine_results(_t(spark, sf_dir, "part").select(F.concat(F.lit("s"), "p_size").alias("signature")).distinct(), packages)


_RUN = "i AS (SELECT user_id AS batch, event_id AS position, list_extract(['listo', 'error', 'terminado', 'pendiente'], event_id % 4 + 1) AS state FROM events)"


def _run(spark, sf_dir):
    state = F.get(F.array(*map(F.lit, ("listo", "error", "terminado", "pendiente"))), (F.col("event_id") % 4).cast("int"))
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("position"), state.alias("state"))


@query(f"WITH {_RUN}, n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY position) AS nth FROM i WHERE state IN ('listo', 'error')) SELECT * FROM n WHERE nth <= 20")
def run_files(spark, sf_dir):
    return Q.run_files(_run(spark, sf_dir), retry_errors=True)


@query(f"WITH {_RUN} SELECT batch, state, count(*) AS n FROM i GROUP BY 1, 2 UNION ALL SELECT NULL, state, count(*) FROM i GROUP BY state")
def state_counts(spark, sf_dir):
    return Q.state_counts(_run(spark, sf_dir))


@query("SELECT p_size % 7 AS suite, count(*) AS files, count(*) FILTER (p_partkey % 5 > 0 AND p_partkey % 3 > 0) AS met, count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 3 = 0) AS unmet FROM part GROUP BY 1")
def outcome_counts(spark, sf_dir):
    k = F.col("p_partkey")
    return Q.outcome_counts(_t(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("suite"), F.when(k % 5 > 0, k % 3 > 0).alias("met")))


@query("""
WITH f AS (SELECT l_orderkey AS package, l_returnflag || l_linestatus AS rule FROM lineitem)
SELECT rule, count(*) AS findings, count(DISTINCT package) AS packages FROM f GROUP BY rule UNION ALL SELECT NULL, count(*), count(DISTINCT package) FROM f
""")
def rule_totals(spark, sf_dir):
    return Q.rule_totals(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package"), F.concat("l_returnflag", "l_linestatus").alias("rule")))


@query("""
WITH n AS (SELECT user_id AS doc_id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT doc_id, nth, text, greatest(n - 40, 0) AS hidden FROM n WHERE nth <= 40
""")
def warnings_shown(spark, sf_dir):
    return Q.first_told(_t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("position"), F.col("event_type").alias("text")), 40)


@query("""
WITH h AS (
  SELECT l_orderkey AS query_id, CASE WHEN l_orderkey % 17 = 0 THEN ' ' ELSE 'size ' || l_orderkey END AS query, CASE WHEN l_partkey % 37 = 0 THEN 'x' ELSE sha256(CAST(l_partkey AS VARCHAR)) END AS d, l_linenumber AS unit,
         'b' || l_suppkey AS block, CASE WHEN l_suppkey % 41 = 0 THEN ' ' WHEN l_orderkey % 5 = 0 THEN repeat('漢', 4000) || l_partkey ELSE 'text "' || l_partkey || '"' END AS excerpt, l_linenumber % 2 = 0 AS cut FROM lineitem),
g AS (SELECT query_id, count(*) AS n, bool_or(query = ' ') AS q, bool_or(d = 'x') AS w, bool_or(excerpt = ' ') AS x, count(DISTINCT (d, unit, block)) AS ids,
             '{"query":"' || min(query) || '","candidates":[' || string_agg('{"document_id":"' || d || '","unit":' || unit || ',"block_id":"' || block || '","text":"' || replace(excerpt, '"', '\\"') || '","truncated":' || cut || '}', ',' ORDER BY unit, d, block, excerpt) || ']}' AS body
      FROM h GROUP BY query_id),
f AS (SELECT *, CASE WHEN q THEN 'query' WHEN n > 10 THEN 'candidates' WHEN w THEN 'identity' WHEN ids < n THEN 'repeated' WHEN x THEN 'excerpt' WHEN strlen(body) > 60000 THEN 'size' END AS fault FROM g)
SELECT query_id, n AS candidates, fault, CASE WHEN fault IS NULL THEN body END AS body FROM f
""")
def judgement_payloads(spark, sf_dir):
    o, p, s, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    hits = _t(spark, sf_dir, "lineitem").select(
        o.alias("query_id"), F.when(o % 17 == 0, " ").otherwise(F.concat(F.lit("size "), o)).alias("query"), F.when(p % 37 == 0, "x").otherwise(T.sha256(p)).alias("document_id"), n.alias("unit"), F.concat(F.lit("b"), s).alias("block_id"),
        F.when(s % 41 == 0, " ").when(o % 5 == 0, F.concat(F.repeat(F.lit("漢"), F.lit(4000)), p)).otherwise(F.concat(F.lit('text "'), p, F.lit('"'))).alias("excerpt"), (n % 2 == 0).alias("excerpt_truncated"), n.alias("rank"), F.lit("/home/me").alias("path"),
    )
    return Q.judgement_payloads(hits)


@query(f"""
WITH {_ITEMS},
l AS (SELECT batch, string_agg('- Página ' || unit || ': **' || CASE WHEN package % 2 = 0 THEN 'terminado' ELSE 'error' END || '**' || CASE WHEN package % 4 = 0 THEN ' · [MD](<../documentos/' || sha256(CAST(package AS VARCHAR)) || '/documento.md>)' ELSE '' END
        || CASE WHEN package % 3 = 0 THEN ' · ' || package || ' tokens' ELSE '' END || CASE WHEN package % 5 = 0 THEN ' · error `' || CASE WHEN package % 7 = 0 THEN 'sin-firma' ELSE 's' || package END || '`: lost' ELSE '' END, chr(10) ORDER BY position) AS lines FROM items GROUP BY batch)
SELECT o_orderkey AS batch, '# Lote IA — T' || o_custkey || chr(10) || chr(10) || 'ID: `' || o_orderkey || '` · estado: **' || o_orderstatus || '**' || chr(10) || chr(10) || 'Proveedor/modelo: `local` / `m' || o_custkey % 3 || '` · perfil API: ' || CASE WHEN o_custkey % 4 = 0 THEN '-' ELSE 'k' || o_custkey % 4 END || ' · perfil CLI: `base`' || chr(10) || chr(10)
       || 'Presupuesto: 20 invocaciones · 5000 tokens reportados. Acumulado: 1 · ' || o_custkey || '; desconocidas: ' || o_custkey % 2 || '.' || chr(10) || chr(10) || '{Q.NOTICE}' || chr(10) || chr(10) || coalesce(lines, '')
       || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || '## Resultado unido' || chr(10) || chr(10) || '[MD](<../documentos/' || sha256(CAST(o_orderkey AS VARCHAR)) || '/documento.md>)' ELSE '' END || chr(10) AS markdown
FROM orders LEFT JOIN l ON o_orderkey = batch
""")
def ai_batch_reports(spark, sf_dir):
    p, k = F.col("package"), F.col("o_orderkey")
    batches = _t(spark, sf_dir, "orders").select(
        k.alias("batch"), F.concat(F.lit("T"), "o_custkey").alias("title"), F.col("o_orderstatus").alias("state"), F.lit("local").alias("provider"), F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"),
        F.when(F.col("o_custkey") % 4 > 0, F.concat(F.lit("k"), F.col("o_custkey") % 4)).alias("key_slot"), F.lit("base").alias("cli_profile"), (F.col("o_custkey") % 2).alias("unknown"), F.lit(1).alias("calls"), F.lit(20).alias("call_budget"), F.col("o_custkey").alias("tokens"), F.lit(5000).alias("token_budget"),
        F.when(k % 3 == 0, F.concat(F.lit("/mem/"), T.sha256(k))).alias("output"),
    )
    items = _items(spark, sf_dir).select(
        "batch", "position", "unit", F.when(p % 2 == 0, "terminado").otherwise("error").alias("state"), F.when(p % 4 == 0, F.concat(F.lit("C:\\mem\\"), T.sha256(p))).alias("output"), F.when(p % 3 == 0, p).alias("tokens"),
        F.when(p % 7 > 0, F.concat(F.lit("s"), p)).alias("signature"), F.when(p % 5 == 0, "lost").alias("error"),
    )
    return Q.batch_reports(batches, items)


@query("SELECT p_partkey, p_name || ';' || chr(10) || '\"x\" ' AS formula, CASE WHEN p_size % 3 > 0 THEN ' ' || p_size END AS value FROM part")
def formula_listing(spark, sf_dir):
    """A listing of formulas written and read again: separators, quotes, blanks and line ends stay."""
    own = _t(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(';\n"x" ')).alias("formula"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit(" "), "p_size")).alias("value"))
    place = f"{shared_dir(spark)}/quire/listing-{uuid.uuid4().hex}"
    listings.write_listing(own, place)
    return listings.read_listing(spark, place, "p_partkey long, formula string, value string")


@query("""
WITH e AS (SELECT list_extract(['FileNotFoundError', 'PermissionError', 'UnicodeDecodeError', 'ImportError', 'OperationalError', 'ValueError', 'RuntimeError'], event_id % 7 + 1) AS kind FROM events)
SELECT kind, list_extract(['path', 'access', 'encoding', 'dependency', 'index', 'control', 'unknown'], list_position(['FileNotFoundError', 'PermissionError', 'UnicodeDecodeError', 'ImportError', 'OperationalError', 'ValueError', 'RuntimeError'], kind)) AS cause,
       kind IN ('FileNotFoundError') AS choose_again, count(*) AS n FROM e GROUP BY ALL
""")
def error_causes(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("FileNotFoundError", "PermissionError", "UnicodeDecodeError", "ImportError", "OperationalError", "ValueError", "RuntimeError")))
    counts = _t(spark, sf_dir, "events").select(F.get(kinds, (F.col("event_id") % 7).cast("int")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    told = counts.withColumn("cause", L.classify_error(F.col("kind")))
    return told.select("kind", "cause", (L.remedy_for(F.col("cause")) == L.REMEDIES["path"]).alias("choose_again"), "n")
