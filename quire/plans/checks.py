"""Queries of contracts, answers, publishing and listings over the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import contracts as C
from quire.operators import library as L
from quire.operators import retrieval as R
from quire.operators.ranges import dealt_to, tasks_for
from quire.session import shared_dir
from quire.sources import answers, files

from .packages import _t, query

_CONTRACT = """
docs AS (
  SELECT l_orderkey AS doc_id, l_orderkey % 11 = 0 AS bad_version, l_orderkey % 13 = 0 OR l_orderkey % 17 = 0 AS bad_title, CASE WHEN l_orderkey % 19 = 0 THEN 0 ELSE max(l_linenumber) END AS n, l_orderkey % 23 = 0 AS twice, l_orderkey % 29 = 0 AS image
  FROM lineitem GROUP BY l_orderkey),
rows_ AS (
  SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 37 = 0 THEN 99 ELSE l_linenumber END AS unit, l_linenumber AS entry, 'b' || (l_suppkey % 60) AS block_id, l_partkey AS p, l_suppkey AS s, l_quantity AS q,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos
  FROM lineitem),
entries AS (SELECT doc_id, unit, entry, bool_and(q < 4) AS blank FROM rows_ GROUP BY ALL),
units AS (SELECT doc_id, unit, count(*) AS entries, count(*) FILTER (blank) AS empty FROM entries GROUP BY ALL),
asked AS (SELECT doc_id, unnest(range(1, n + 1)) AS unit FROM docs UNION SELECT doc_id, 1 FROM docs WHERE twice),
faults AS (
  SELECT doc_id, unnest(list_filter([CASE WHEN bad_version THEN 'version' END, CASE WHEN bad_title THEN 'title' END, CASE WHEN n = 0 AND NOT twice THEN 'scope' END, CASE WHEN twice THEN 'scope_repeated' END], lambda x: x IS NOT NULL)) AS rule, NULL AS unit, 1 AS n FROM docs
  UNION ALL SELECT u.doc_id, 'unit', u.unit, entries - CASE WHEN a.unit IS NULL THEN 0 ELSE 1 END FROM units u LEFT JOIN asked a ON a.doc_id = u.doc_id AND a.unit = u.unit
  UNION ALL SELECT doc_id, 'empty', unit, empty FROM units
  UNION ALL SELECT a.doc_id, 'missing', a.unit, 1 FROM asked a LEFT JOIN units u ON a.doc_id = u.doc_id AND a.unit = u.unit WHERE u.unit IS NULL
  UNION ALL SELECT doc_id, 'block', unit, count(*) FILTER (p % 31 = 0 OR nth > 1) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY entry, pos) AS nth FROM rows_) GROUP BY doc_id, unit
  UNION ALL SELECT doc_id, 'level', unit, count(*) FILTER (p % 31 > 0 AND p % 3 = 0 AND s % 2 = 0 AND s % 9 NOT BETWEEN 1 AND 6) FROM rows_ GROUP BY doc_id, unit
  UNION ALL SELECT doc_id, 'image', 2, 1 FROM docs WHERE image)
"""


def _contract(spark, sf_dir):
    """A document an order, its lines as units; every kind of fault somewhere."""
    li, k = _t(spark, sf_dir, "lineitem"), F.col("doc_id")
    tasks = tasks_for(li.count())
    documents = dealt_to(li.select("l_orderkey", "l_linenumber"), tasks, "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_linenumber").alias("n")).select(
        "doc_id", F.when(k % 11 == 0, 2).otherwise(1).alias("schema_version"), F.when(k % 13 == 0, None).when(k % 17 == 0, " \t").otherwise("Title").alias("title"),
        F.concat(F.when(k % 19 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), "n")), F.when(k % 23 == 0, F.when(k % 19 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))).otherwise(F.array().cast("array<int>"))).alias("expected"),
        F.when(k % 29 == 0, F.array(F.lit(2))).alias("missing_images"),
    )
    from pyspark.sql import Window

    p, s = F.col("l_partkey"), F.col("l_suppkey")
    pos = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    text = F.when(F.col("l_quantity") < 4, " \n").when(F.col("l_quantity") > 45, "[Verificar cota] text").otherwise("text")
    blocks = dealt_to(li, tasks, "l_orderkey", "l_linenumber").select(
        F.col("l_orderkey").alias("doc_id"), F.when(p % 37 == 0, 99).otherwise(F.col("l_linenumber")).alias("unit"), F.col("l_linenumber").alias("entry"), pos.alias("pos"), F.concat(F.lit("b"), s % 60).alias("block_id"),
        F.when(p % 31 == 0, "poem").when(p % 3 == 0, "heading").otherwise("paragraph").alias("kind"), F.when(s % 2 == 0, (s % 9).cast("int")).alias("level"), text.alias("text"),
    )
    return documents, blocks


@query(f"WITH {_CONTRACT} SELECT doc_id, rule, CAST(unit AS INTEGER) AS unit, CAST(n AS BIGINT) AS n FROM faults WHERE n > 0")
def qa_contract(spark, sf_dir):
    return C.contract_faults(*_contract(spark, sf_dir))


@query(f"""
WITH {_CONTRACT},
e AS (SELECT doc_id, string_agg(repeat(rule || coalesce(' ' || unit, '') || ';', CAST(n AS INT)), '' ORDER BY rule || coalesce(' ' || unit, '')) AS errors FROM faults WHERE n > 0 GROUP BY doc_id),
w AS (SELECT doc_id, string_agg('doubt ' || unit || ';', '' ORDER BY 'doubt ' || unit) AS warnings FROM (SELECT DISTINCT doc_id, unit FROM rows_ WHERE q > 45) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN errors IS NULL THEN 'revisar' ELSE 'parcial' END AS status, coalesce(errors, '') AS errors, coalesce(warnings, '') AS warnings FROM docs d LEFT JOIN e USING (doc_id) LEFT JOIN w USING (doc_id)
""")
def qa_verdict(spark, sf_dir):
    ended = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(";"))), "")
    return C.contract_verdict(*_contract(spark, sf_dir)).select("doc_id", "status", ended("errors").alias("errors"), ended("warnings").alias("warnings"))


@query("""
SELECT conv_id AS doc_id, turn AS unit, turn % 8 IN (0, 1) AS accepted,
       list_extract([NULL, NULL, 'another job', 'keys', 'block', 'no blocks', 'block', 'not strict JSON'], turn % 8 + 1) AS reason, CASE WHEN turn % 8 IN (0, 1) THEN 'turn ' || turn || chr(10) || chr(10) END AS text
FROM conversations
""")
def answers_strict(spark, sf_dir):
    """Answers to jobs, some fenced, some of another job, with more keys, unknown kinds, no blocks, blank text or repeated keys."""
    case = F.col("turn") % 8
    kind, text = F.when(case == 4, "poem").otherwise("paragraph"), F.when(case == 6, " ").otherwise(F.concat(F.lit("turn "), "turn", F.lit("  ")))
    blocks = F.when(case == 5, "").otherwise(F.concat(F.lit('{"kind": "'), kind, F.lit('", "text": "'), text, F.lit('"}')))
    job = F.concat(F.lit("j"), F.when(case == 2, "x").otherwise(F.col("conv_id").cast("string")))
    body = F.concat(F.lit('{"job": "'), job, F.lit('", "unit": '), "turn", F.when(case == 3, ', "more": 1').when(case == 7, ', "unit": 1').otherwise(""), F.lit(', "blocks": ['), blocks, F.lit("]}"))
    told = F.when(case == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    asked = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("j"), "conv_id").alias("job"), F.col("turn").cast("int").alias("unit"), told.alias("answer"))
    # The unit comes back from the answer's place: one answer a turn.
    read = answers.read_answers(asked.withColumn("doc_id", F.struct("doc_id", "unit")))
    return read.select("doc_id.doc_id", F.col("doc_id.unit").cast("long").alias("unit"), "accepted", "reason", F.get("blocks", F.lit(0))["text"].alias("text"))


@query("""
WITH d AS (SELECT DISTINCT sha256(text) AS sha, source, doc_id % 2 = 0 AS early FROM documents),
a AS (SELECT DISTINCT sha, source FROM d WHERE early), b AS (SELECT DISTINCT sha, source FROM d EXCEPT SELECT sha, source FROM a)
SELECT 1 AS run, count(*) AS packages FROM a UNION ALL SELECT 2, count(*) FROM b
""")
def publish_once(spark, sf_dir):
    """Two runs into one folder: what the first has published intact, the second does not publish again."""
    own = _t(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("sha"), "source")
    ids = answers.package_ids(own, 7, ["sha", "source"])
    place = f"{shared_dir(spark)}/quire/packages-{uuid.uuid4().hex}"
    first = answers.publish(ids.filter("doc_id % 2 = 0"), None, place)
    catalog = first.select("package_id", F.lit(True).alias("integrity_ok"))
    runs = [r.select(F.lit(k).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("packages")) for k, r in ((1, first), (2, answers.publish(ids, catalog, place)))]
    return runs[0].unionByName(runs[1])


@query("""
SELECT '/in/' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'gone' ELSE 'changed' END AS change
FROM documents WHERE (doc_id % 10 = 0 AND doc_id % 7 <> 0) OR (doc_id % 10 <> 0 AND doc_id % 7 = 0) OR (doc_id % 10 <> 0 AND doc_id % 7 <> 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 1))
""")
def listing_changes(spark, sf_dir):
    i = F.col("doc_id")
    at = lambda days: F.timestamp_seconds(F.lit(1_700_000_000) + i * 60 + days * 86400)
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/"), "doc_id").alias("path"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    before = d.filter("doc_id % 10 <> 0").select("path", F.col("n").alias("length"), at(F.lit(0)).alias("modificationTime"))
    after = d.filter("doc_id % 7 <> 0").select("path", (F.col("n") + (i % 3 == 0).cast("int")).alias("length"), at((i % 5 == 1).cast("int")).alias("modificationTime"))
    return files.changed_files(before, after)


@query("""
SELECT p_partkey, repeat('`', CASE WHEN p_size % 6 = 0 THEN 3 ELSE greatest(p_size % 6 + 1, 3) END) AS fence, '{"a": ' || p_size || '}' AS body, p_size % 3 < 2 AS valid,
       round(radians(CASE WHEN (p_size * 15 % 360) = 0 THEN 360 ELSE p_size * 15 % 360 END) * 2, 6) AS arc
FROM part
""")
def text_marks(spark, sf_dir):
    """Code fences, fenced answers, judgements and arcs."""
    size = F.col("p_size")
    body = F.concat(F.lit('{"a": '), size, F.lit("}"))
    fenced = F.when(size % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    score = F.lit(1.1) + (size % 3) * 0.0145
    return _t(spark, sf_dir, "part").select(
        "p_partkey", T.code_fence(F.concat("p_name", F.lit(" "), F.expr("repeat('`', cast(p_size % 6 AS int))"), F.lit(" x"))).alias("fence"), T.fenced_json(fenced).alias("body"),
        T.valid_scores(score, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))).alias("valid"), F.round(T.arc_length((size * 10).cast("double"), (size * 25).cast("double"), F.lit(2.0)), 6).alias("arc"),
    )


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 5 = 2 THEN 'not utf-8' WHEN doc_id % 5 = 1 OR regexp_full_match(t, '\\s*') THEN 'blank' ELSE 'unit' END AS state FROM d)
SELECT '/in/a.b/' || doc_id || '.x.md' AS path, doc_id || '.x' AS title, CASE WHEN state = 'unit' THEN 1 END AS unit, state, CASE WHEN state = 'unit' THEN sha256(t) END AS text_sha256,
       CASE doc_id % 5 WHEN 0 THEN sha256(chr(65279) || t) WHEN 1 THEN sha256(chr(65279) || chr(160) || ' ' || chr(10)) WHEN 2 THEN sha256('\\xFF\\x41'::BLOB) ELSE sha256(t) END AS sha256
FROM s
""")
def text_units(spark, sf_dir):
    """Texts with and without the mark of their encoding, blank ones and such as are not UTF-8."""
    k, text = F.col("doc_id") % 5, F.coalesce("text", F.lit("")).cast("binary")
    mark = F.lit(files.MARK)
    content = F.when(k == 0, F.concat(mark, text)).when(k == 1, F.concat(mark, F.lit("\u00a0 \n").cast("binary"))).when(k == 2, F.lit(b"\xff\x41")).otherwise(text)
    found = files.text_units(_t(spark, sf_dir, "documents").select(F.concat(F.lit("/in/a.b/"), "doc_id", F.lit(".x.md")).alias("path"), content.alias("content")))
    return found.select("path", "title", "sha256", "unit", "state", T.sha256(F.col("text")).alias("text_sha256"))


@query("""
WITH k AS (SELECT o_orderkey, list_extract(['md', 'docx', 'pdf', 'zip', 'empty', 'csv', NULL, 'pdf', 'zip-damaged', 'unsupported'], CAST(o_orderkey % 10 + 1 AS INT)) AS kind, CASE WHEN o_custkey % 9 > 0 THEN o_custkey * 37 % 2500 * (o_custkey % 8) END AS pages FROM orders),
r AS (SELECT *, CASE WHEN kind = 'pdf' THEN CASE WHEN pages IS NULL THEN 'damaged document' WHEN pages < 1 THEN 'no pages' WHEN pages > 2000 THEN 'prepare its pages in parts' END
  WHEN kind = 'zip' THEN 'archive of no document' WHEN kind = 'empty' THEN 'empty file' WHEN kind = 'zip-damaged' THEN 'damaged archive' WHEN kind = 'unsupported' THEN 'unknown binary content'
  WHEN kind = 'csv' THEN 'no adapter for csv' WHEN kind IS NULL THEN 'unknown kind' END AS reason FROM k)
SELECT '/in/' || o_orderkey AS path, kind, CAST(pages AS BIGINT) AS pages, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN kind = 'pdf' THEN 'pages' WHEN kind = 'md' THEN 'text' ELSE 'native' END AS route, reason FROM r
""")
def entry_routes(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("md", "docx", "pdf", "zip", "empty", "csv", None, "pdf", "zip-damaged", "unsupported")))
    c = F.col("o_custkey").cast("long")
    pages = F.when(c % 9 > 0, c * 37 % 2500 * (c % 8))
    return L.entry_routes(_t(spark, sf_dir, "orders").select(F.concat(F.lit("/in/"), "o_orderkey").alias("path"), F.get(kinds, (F.col("o_orderkey") % 10).cast("int")).alias("kind"), pages.alias("pages")))


@query("""
WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'),
a AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 11 > 0 THEN 'c' || event_id END AS cause, CASE WHEN event_id % 5 > 0 THEN 'seen' ELSE chr(10) END AS evidence FROM events),
r AS (SELECT a.*, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 5 = 0 THEN 'cause and evidence are needed' WHEN f.user_id IS NULL THEN 'unknown signature' END AS reason FROM a LEFT JOIN f ON f.user_id = a.user_id)
SELECT 's' || user_id AS signature, cause, evidence, CASE WHEN reason IS NULL THEN 'resuelto' ELSE 'rechazado' END AS status, reason FROM r
""")
def failures_resolved(spark, sf_dir):
    e, i = _t(spark, sf_dir, "events"), F.col("event_id")
    signature = F.concat(F.lit("s"), "user_id").alias("signature")
    asked = e.select(signature, F.when(i % 7 == 0, " ").when(i % 11 > 0, F.concat(F.lit("c"), i)).alias("cause"), F.when(i % 5 > 0, "seen").otherwise("\n").alias("evidence"))
    return L.resolve_failures(e.filter("event_type = 'error'").select(signature), asked)


@query("""
WITH d AS (SELECT doc_id, '/in/' || doc_id AS path, sha256(text) AS sha FROM documents),
o AS (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha END AS old, CASE WHEN doc_id % 4 > 0 THEN 'out' || doc_id END AS output FROM d WHERE doc_id % 5 <> 0),
s AS (SELECT path, sha, CASE WHEN doc_id % 3 = 0 THEN 'requiere_paginas' ELSE 'listo' END AS fresh FROM d WHERE doc_id % 6 <> 0),
b AS (SELECT coalesce(o.path, s.path) AS path, old, sha, output, fresh, coalesce(old = sha AND output IS NOT NULL AND doc_id % 9 > 0, false) AS kept FROM o FULL JOIN s ON o.path = s.path)
SELECT path, coalesce(sha, old) AS sha256, CASE WHEN fresh IS NULL OR kept THEN 'terminado' ELSE fresh END AS status, old IS NOT NULL AND sha IS NOT NULL AND old <> sha AS source_changed,
       CASE WHEN fresh IS NULL OR kept THEN output END AS output FROM b
""")
def queue_upsert_intact(spark, sf_dir):
    i = F.col("doc_id")
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/"), "doc_id").alias("path"), T.sha256(F.col("text")).alias("sha256"), F.concat(F.lit("out"), "doc_id").alias("made"))
    old = d.filter("doc_id % 5 <> 0").select("path", F.when(i % 7 == 0, "old").otherwise(F.col("sha256")).alias("sha256"), F.lit("terminado").alias("status"), F.when(i % 4 > 0, F.col("made")).alias("output"))
    seen = d.filter("doc_id % 6 <> 0").select("path", "sha256", F.when(i % 3 == 0, "pdf").otherwise("md").alias("format"))
    return L.upsert_queue(old, seen, d.filter("doc_id % 9 > 0").select(F.col("made").alias("output")))


_CONVERSATIONS = "c AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id AS doc_id, 't' || conv_id % 7 AS title, 'ok' AS status, conv_id % 4 > 0 AND conv_id % 9 > 0 AS integrity_ok, CASE WHEN conv_id % 4 > 0 AND conv_id % 9 > 0 AND conv_id % 5 > 0 THEN 'k' || conv_id % 3 ELSE '' END AS kind FROM c)"


def _report(spark, sf_dir, query=None):
    turns, k = _t(spark, sf_dir, "conversations"), F.col("doc_id")
    docs = turns.select(F.col("conv_id").alias("doc_id")).distinct()
    blocks = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("unit"), F.lit(1).alias("block_no"), "text")
    intact = docs.filter(k % 9 > 0).select("doc_id", (k % 4 > 0).alias("integrity_ok"))
    kinds = docs.filter(k % 5 > 0).select("doc_id", F.concat(F.lit("k"), k % 3).alias("input_kind"))
    return R.library_report(docs.select("doc_id", F.concat(F.lit("t"), k % 7).alias("title"), F.lit("ok").alias("status")), intact, kinds, blocks, query)


@query(f"WITH {_CONVERSATIONS} SELECT * FROM r")
def library_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query(f"""
WITH {_CONVERSATIONS}, u AS (SELECT conv_id AS doc_id, string_agg((turn + 1)::varchar, ',' ORDER BY turn) AS units FROM conversations WHERE contains(lower(text), 'the on') GROUP BY conv_id)
SELECT r.*, units FROM r JOIN u ON u.doc_id = r.doc_id WHERE integrity_ok
""")
def library_search(spark, sf_dir):
    return _report(spark, sf_dir, "The On").withColumn("units", F.array_join(F.col("units").cast("array<string>"), ","))
