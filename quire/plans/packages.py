"""Queries of packages, batches, reports and views over the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import documents as D
from quire.operators import packages as P
from quire.operators import sheets as S
from quire.operators import views as V
from quire.operators.ranges import dealt

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH c AS (SELECT conv_id AS doc_id, turn + 1 AS unit, turn, text FROM conversations),
e AS (SELECT doc_id, max(unit) + 1 AS n FROM c GROUP BY 1),
f AS (SELECT doc_id, unit, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text FROM c UNION ALL SELECT doc_id, unit, text FROM c WHERE turn % 7 = 3),
g AS (SELECT doc_id, unit, count(*) AS files, min(text) AS text FROM f GROUP BY 1, 2),
x AS (SELECT e.doc_id, u.unit, files, text FROM e, LATERAL (SELECT unnest(range(1, n + 1)) AS unit) u LEFT JOIN g ON g.doc_id = e.doc_id AND g.unit = u.unit),
s AS (SELECT *, CASE WHEN files IS NULL THEN 'missing' WHEN files > 1 THEN 'ambiguous' WHEN trim(coalesce(text, '')) = '' THEN 'empty' ELSE 'imported' END AS state FROM x)
SELECT doc_id, unit, state, CASE WHEN state = 'imported' THEN length(text) END AS n_chars FROM s
""")
def paged_import(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("unit"), "turn", "text")
    name = lambda zeros: F.concat(F.lit("chat_p"), zeros, F.col("unit"), F.lit(".md"))
    text = F.when(F.col("turn") % 5 == 4, F.lit("\ufeff \n")).otherwise(F.concat(F.lit("\ufeff"), "text"))
    files = c.select("doc_id", name(F.expr("repeat('0', cast(turn % 3 AS int))")).alias("name"), text.alias("text"))
    again = c.filter("turn % 7 = 3").select("doc_id", name(F.lit("0000")).alias("name"), "text")
    others = c.select("doc_id", F.concat(F.lit("notes_p"), "unit", F.lit(".md")).alias("name"), "text")
    expected = c.groupBy("doc_id").agg(F.sequence(F.lit(1), F.max("unit") + 1).alias("expected"))
    found = P.import_pages(expected, files.unionByName(again).unionByName(others), "chat")
    return found.select("doc_id", "unit", "state", F.length("text").alias("n_chars"))


@query("""
WITH p AS (SELECT doc_id AS id, sha256(text) AS sha256, doc_id % 3 + 1 AS pages, CASE WHEN doc_id % 2 = 0 THEN 150 ELSE 200 END AS dpi, doc_id * 7 % 1000 AS updated
           FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 <> 0),
n AS (SELECT sha256, pages, dpi, arg_max(id, updated * 1000000000 + id) AS prepared_id FROM p GROUP BY ALL)
SELECT r.sha256, n.prepared_id FROM (SELECT DISTINCT sha256(text) AS sha256 FROM documents) r LEFT JOIN n ON r.sha256 = n.sha256 AND pages = 2 AND dpi = 150
""")
def prepared_lookup(spark, sf_dir):
    d, i = _t(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("sha256")), F.col("doc_id")
    packages = d.select(
        i.alias("id"), "sha256", F.sequence(F.lit(1), (i % 3 + 1).cast("int")).alias("pages"), F.when(i % 2 == 0, 150).otherwise(200).alias("dpi"),
        F.when(i % 5 == 0, 6).otherwise(7).alias("version"), (i * 7 % 1000).alias("updated"), (i % 11 != 0).alias("integrity_ok"),
    )
    asked = d.select("sha256").distinct().select("sha256", F.array(F.lit(1), F.lit(2)).alias("pages"), F.lit(150).alias("dpi"))
    return P.prepared(asked, packages, 7).select("sha256", "prepared_id")


def _batches(spark, sf_dir):
    k = F.col("o_custkey")
    state = F.when(F.col("o_orderstatus") == "F", "finalizado").otherwise("pausado")
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), k.alias("source"), F.when(F.col("o_orderkey") % 3 == 0, k * 3).alias("output"), state.alias("state"))


@query("SELECT o_custkey AS source, max(o_orderkey) AS batch FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1")
def pending_batches(spark, sf_dir):
    return P.unfinished_sources(_batches(spark, sf_dir), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source")))


@query("""
WITH intact AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0)
SELECT DISTINCT o_orderkey AS batch FROM orders WHERE o_custkey NOT IN (SELECT k FROM intact) OR (o_orderkey % 3 = 0 AND o_custkey * 3 NOT IN (SELECT k FROM intact))
""")
def orphan_batches(spark, sf_dir):
    return P.orphan_batches(_batches(spark, sf_dir), _t(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("package")))


@query("""
WITH i AS (SELECT p_partkey AS batch, unnest(range(0, p_size % 6 + 1)) AS position FROM part)
SELECT batch, position, 'file' || position AS path, CASE WHEN (batch + position) % 4 = 0 THEN 'terminado' WHEN (batch + position) % 4 = 1 THEN 'error' ELSE 'listo' END AS state FROM i
""")
def item_states(spark, sf_dir):
    last = (F.col("p_size") % 6).cast("int")
    plans = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("batch"), F.transform(F.sequence(F.lit(0), last), lambda n: F.concat(F.lit("file"), n)).alias("paths"))
    at = plans.select("batch", F.posexplode("paths").alias("position", "path"))
    turn = (F.col("batch") + F.col("position")) % 4
    return P.item_states(plans, at.filter(turn < 2).select("batch", "position", F.when(turn == 0, "terminado").otherwise("error").alias("state")))


_ITEMS = """
items AS (SELECT DISTINCT l_orderkey AS batch, l_linenumber AS position, l_linenumber AS unit, min(l_partkey) AS package FROM lineitem GROUP BY 1, 2, 3)
"""


def _items(spark, sf_dir):
    li = dealt(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("package"))
    return li.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("position"), F.col("l_linenumber").alias("unit"), "package")


@query(f"""
WITH {_ITEMS},
u AS (SELECT p_partkey AS package, unnest(range(1, p_size % 9 + 2)) AS unit FROM part UNION ALL SELECT p_partkey, 1 FROM part WHERE p_partkey % 10 = 0),
g AS (SELECT package, unit, count(*) AS found FROM u GROUP BY 1, 2),
x AS (SELECT batch, position, i.unit, i.package, CASE WHEN found IS NULL THEN 'absent' WHEN found > 1 THEN 'several' END AS fault FROM items i LEFT JOIN g ON i.package = g.package AND i.unit = g.unit)
SELECT batch, count(*) AS items, count(*) FILTER (fault IS NULL) AS merged, coalesce(string_agg(unit || ': ' || fault, ', ' ORDER BY position) FILTER (fault IS NOT NULL), '') AS problems,
       CASE WHEN count(fault) = 0 THEN 'published' ELSE 'refused' END AS status, CASE WHEN count(fault) = 0 THEN string_agg(package || '/' || unit || chr(10), '' ORDER BY position) END AS markdown
FROM x GROUP BY batch
""")
def batch_merge(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("package"), "p_size")
    units = part.select("package", F.explode(F.sequence(F.lit(1), (F.col("p_size") % 9 + 1).cast("int"))).alias("unit"))
    units = units.unionByName(part.filter("package % 10 = 0").select("package", F.lit(1).alias("unit")))
    return P.merge_batch(_items(spark, sf_dir), units.withColumn("text", F.concat("package", F.lit("/"), "unit", F.lit("\n"))))


@query(f"WITH {_ITEMS} SELECT batch, position, 'Página ' || unit || ': size ' || p_size AS warning FROM items JOIN part ON package = p_partkey WHERE p_size % 5 = 0")
def page_warnings(spark, sf_dir):
    told = _t(spark, sf_dir, "part").filter("p_size % 5 = 0").select(F.col("p_partkey").alias("package"), F.concat(F.lit("size "), "p_size").alias("warning"))
    return P.page_warnings(_items(spark, sf_dir), told)


@query(f"""
WITH {_ITEMS}
SELECT batch, count(*) AS pages, sha256('reader' || chr(10) || string_agg(position || '|' || unit || '|' || sha256(CAST(package AS VARCHAR)), chr(10) ORDER BY position)) AS plan_id FROM items GROUP BY batch
""")
def plan_ids(spark, sf_dir):
    return P.plan_ids(_items(spark, sf_dir).withColumn("sha256", T.sha256(F.col("package"))), "reader")


@query("""
WITH j AS (SELECT event_id AS job, sha256(user_id || event_type) AS signature FROM events),
l AS (SELECT sha256(user_id || event_type) AS signature, count(*) FILTER (user_id % 4 = 0) AS responses FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1),
f AS (SELECT signature, min(job) AS first FROM j GROUP BY 1)
SELECT job, j.signature, CASE WHEN responses > 0 THEN 'reuse' WHEN responses = 0 THEN 'review' WHEN job = first THEN 'send' ELSE 'wait' END AS action
FROM j JOIN f ON j.signature = f.signature LEFT JOIN l ON j.signature = l.signature
""")
def reserve_jobs(spark, sf_dir):
    e, signature = _t(spark, sf_dir, "events"), T.sha256(F.concat("user_id", "event_type")).alias("signature")
    ledger = e.filter("event_type = 'click' AND user_id % 2 = 0").select(signature, F.when(F.col("user_id") % 4 == 0, F.lit("answer")).alias("response"))
    return P.reserve(e.select(F.col("event_id").alias("job"), signature), ledger)


@query("SELECT l_orderkey AS doc_id, sum(CAST(l_quantity AS BIGINT)) AS bytes, sum(CAST(l_quantity AS BIGINT)) <= 120 AS accepted FROM lineitem GROUP BY 1")
def package_cap(spark, sf_dir):
    return P.over_cap(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("long").alias("bytes")), 120)


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'deleted' END AS outcome FROM documents
""")
def deletion_plan(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id")
    return P.deletions(d, d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 7 = 0"))


@query("SELECT 'part/' || p_partkey AS file, CASE WHEN p_partkey % 23 = 0 THEN 'ausente' ELSE 'modificado' END AS status FROM part WHERE p_partkey % 23 = 0 OR p_partkey % 29 = 0")
def manifest_problems(spark, sf_dir):
    told = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part/"), "p_partkey").alias("file"), T.sha256(F.col("p_name")).alias("sha256"))
    disk = told.filter("p_partkey % 23 <> 0").withColumn("sha256", F.when(F.col("p_partkey") % 29 == 0, "other").otherwise(F.col("sha256")))
    return P.manifest_problems(told.select("file", "sha256"), disk.select("file", "sha256"))


@query("""
WITH n AS (SELECT o_orderkey AS run, o_orderdate AS started FROM orders ORDER BY started DESC, run DESC LIMIT 50),
l AS (SELECT l_orderkey AS run, sum(CAST(l_quantity AS BIGINT)) AS tokens, count(*) FILTER (l_returnflag = 'R') AS errors FROM lineitem GROUP BY 1)
SELECT n.run, started, tokens, coalesce(errors, 0) AS errors FROM n LEFT JOIN l ON n.run = l.run
""")
def run_history(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started"))
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_quantity").cast("long").alias("tokens"), "l_returnflag")
    return P.run_history(runs, li.select("run", "tokens"), li.filter("l_returnflag = 'R'").select("run"))


@query("""
SELECT 'Report (' || source || ')' || ' x' AS title, doc_id,
       '- [Report (' || source || ') x](<documentos/' || doc_id || '/documento.md>) — **revisar**, ' || CASE WHEN doc_id % 13 = 0 THEN 'integridad dañada' ELSE doc_id % 5 || '/5 unidades; ' || doc_id % 3 || ' avisos' END || '.' AS line
FROM (SELECT doc_id, coalesce(source, '?') AS source FROM documents)
""")
def library_index(spark, sf_dir):
    i = F.col("doc_id")
    d = _t(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("?")))
    catalog = d.select("doc_id", F.concat(F.lit("Report ["), "source", F.lit("]\nx")).alias("title"), F.lit("revisar").alias("status"), (i % 13 != 0).alias("integrity_ok"), (i % 5).alias("received"), F.lit(5).alias("expected"), (i % 3).alias("warnings"))
    return P.library_index(catalog).select(F.translate(F.regexp_replace("title", "\n", " "), "[]", "()").alias("title"), "doc_id", "line")


@query("""
WITH f AS (SELECT user_id AS signature, max(ts) AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1),
r AS (SELECT user_id AS signature, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS history FROM (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup') GROUP BY 1)
SELECT f.signature, last_seen, coalesce(history, '') AS history FROM f LEFT JOIN r ON f.signature = r.signature
""")
def failure_report(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    failures = e.filter("event_type = 'error'").groupBy(F.col("user_id").alias("signature")).agg(F.max("ts").alias("last_seen"))
    solved = e.filter("event_type = 'signup'").select(F.col("user_id").alias("signature"), F.col("ts").alias("resolved_at"), F.col("event_id").alias("cause"))
    told = P.failure_report(failures, solved)
    return told.select("signature", "last_seen", F.array_join(F.transform("history", lambda h: h["cause"].cast("string")), ",").alias("history"))


@query("""
SELECT doc_id AS number, concat_ws(' | ', doc_id, CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'pdf' END, CASE WHEN doc_id % 2 = 1 THEN 'pendiente' WHEN doc_id % 4 = 0 THEN 'duplicado' ELSE 'local' END,
       CASE WHEN doc_id % 3 = 0 THEN 'terminado' ELSE 'sin estado' END, CASE WHEN doc_id % 2 = 1 THEN 'choose pages first' WHEN doc_id % 4 = 0 THEN 'igual a ' || (doc_id - 2) ELSE '-' END) AS line
FROM documents
""")
def batch_report(spark, sf_dir):
    d, i = _t(spark, sf_dir, "documents"), F.col("doc_id")
    route = F.when(i % 2 == 1, "pendiente").when(i % 4 == 0, "duplicado").otherwise("local")
    plan = d.select(i.alias("number"), F.when(i % 2 == 0, "md").otherwise("pdf").alias("format"), route.alias("route"), F.when(route == "duplicado", i - 2).alias("duplicate_of"), F.when(route == "pendiente", "choose pages first").alias("reason"))
    return P.batch_report(plan, d.filter("doc_id % 3 = 0").select(i.alias("number"), F.lit("terminado").alias("state")))


@query("""
SELECT 'integrity' AS "check", count(*) AS total, count(*) FILTER (page_id % 17 = 0) AS faults, CASE WHEN count(*) FILTER (page_id % 17 = 0) > 0 THEN 'ATENCION' ELSE 'OK' END AS status FROM pages
UNION ALL SELECT 'batches', count(*), count(*) FILTER (o_orderstatus = 'P'), CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'ATENCION' ELSE 'OK' END FROM orders
UNION ALL SELECT 'index', count(*), 0, 'OK' FROM nation
""")
def diagnostics(spark, sf_dir):
    return (
        P.check("integrity", _t(spark, sf_dir, "pages"), F.col("page_id") % 17 == 0)
        .unionByName(P.check("batches", _t(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P"))
        .unionByName(P.check("index", _t(spark, sf_dir, "nation"), F.col("n_name").isNull()))
    )


@query("""
SELECT event_type, count(*) AS runs, sum(t) AS tokens, count(*) FILTER (t IS NULL) AS unknown
FROM (SELECT event_type, event_id % 7 + CASE WHEN event_id % 3 > 0 THEN user_id END + CASE WHEN event_id % 5 > 0 THEN 2 END AS t FROM events) GROUP BY event_type
""")
def usage_totals(spark, sf_dir):
    i = F.col("event_id")
    total = P.summed_usage(i % 7, F.when(i % 3 > 0, F.col("user_id")), F.when(i % 5 > 0, F.lit(2)).otherwise(-1))
    e = _t(spark, sf_dir, "events").select("event_type", total.alias("t"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.sum("t").alias("tokens"), F.count_if(F.col("t").isNull()).alias("unknown"))


@query("""
WITH RECURSIVE i AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS ord, min(l_quantity) > 10 AS is_list, min(l_suppkey) % 6 AS level, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n
  FROM lineitem GROUP BY 1, 2),
w AS (
  SELECT doc_id, ord, is_list, level, n, CASE WHEN is_list THEN least(level, 0) END AS nested FROM i WHERE n = 1
  UNION ALL
  SELECT i.doc_id, i.ord, i.is_list, i.level, i.n, CASE WHEN i.is_list THEN least(i.level, coalesce(w.nested, -1) + 1) END FROM w JOIN i ON i.doc_id = w.doc_id AND i.n = w.n + 1)
SELECT doc_id, ord, is_list, level, nested FROM w
""")
def list_levels(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"))
    return P.list_levels(li.agg((F.min("l_quantity") > 10).alias("is_list"), (F.min("l_suppkey") % 6).alias("level")))


@query("""
WITH t AS (SELECT p_partkey AS doc_id, p_size % 15 + 1 AS k, p_partkey % 5 > 0 AS ruled FROM part)
SELECT doc_id, CASE WHEN ruled THEN 2 ELSE 3 END AS rows, k AS width, k > 12 AS wide, CAST(round_even(100.0 * (k // 2 + k - 1) / (CASE WHEN ruled THEN 2 ELSE 3 END * k), 0) AS BIGINT) AS empty_percent,
       CASE WHEN ruled THEN k // 2 ELSE 0 END AS empty_columns
FROM t
""")
def table_shapes(spark, sf_dir):
    k = (F.col("p_size") % 15 + 1).cast("int")
    row = lambda cell: F.concat(F.lit("|"), F.array_join(F.transform(F.sequence(F.lit(1), k), cell), "|"), F.lit("|\n"))
    rule = F.when(F.col("p_partkey") % 5 > 0, row(lambda i: F.lit("---"))).otherwise("")
    text = F.concat(row(lambda i: F.concat(F.lit(" h"), i)), rule, row(lambda i: F.when(i % 2 == 1, " v ").otherwise(" ")), row(lambda i: F.when(i == 1, "z").otherwise("")))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), V.table_shape(text).alias("s")).select("doc_id", "s.*")


@query("""
WITH e AS (SELECT p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN 'INSERT' ELSE 'TEXT' END AS kind, CASE WHEN p_size % 3 = 0 THEN p_brand END AS block, CASE WHEN p_size % 3 > 0 THEN p_name || ' ø' || p_size % 2 ELSE '1.20' END AS text FROM part)
SELECT 'kind' AS section, kind AS name, count(*) AS n FROM e GROUP BY kind
UNION ALL SELECT * FROM (SELECT 'block', block, count(*) AS n FROM e WHERE block IS NOT NULL GROUP BY block ORDER BY n DESC, block LIMIT 25)
UNION ALL SELECT 'text', text, n FROM (SELECT replace(text, 'ø', 'Ø') AS text, count(*) AS n, min(ord) AS seen FROM e WHERE text <> '1.20' GROUP BY 1 ORDER BY seen LIMIT 120)
""")
def drawing_summary(spark, sf_dir):
    insert = F.col("p_size") % 3 == 0
    entities = _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.when(insert, "INSERT").otherwise("TEXT").alias("kind"), F.when(insert, F.col("p_brand")).alias("block"),
        F.when(insert, F.lit("1.20")).otherwise(F.concat("p_name", F.lit("  %%c"), F.col("p_size") % 2)).alias("text"),
    )
    return V.drawing_summary(entities)


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'L=' || v || ' m' WHEN 2 THEN '?' WHEN 3 THEN 'fixed' ELSE v END AS text
FROM (SELECT p_partkey, p_size, regexp_replace(regexp_replace(format('{:.4f}', p_retailprice), '0+$', ''), '\\.$', '') AS v FROM part)
""")
def dimension_texts(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, (" . ", "L=<> m", "<>", "fixed"))), (F.col("p_size") % 5).cast("int"))
    measure = F.when(F.col("p_size") % 5 != 2, F.col("p_retailprice"))
    return _t(spark, sf_dir, "part").select("p_partkey", V.dimension_text(raw, measure).alias("text"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS unit FROM lineitem WHERE l_suppkey % 5 <> 0 AND (l_partkey % 400 < 150 OR CAST(l_quantity AS BIGINT) % 8 >= 6)")
def vision_pages(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    units = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("unit"), F.when(F.col("l_suppkey") % 5 != 0, "p.png").alias("image"), (F.col("l_partkey") % 400).alias("characters"), (F.col("l_quantity").cast("long") % 8).alias("graphics"))
    return V.vision_pages(units)


@query("""
WITH cells AS (SELECT DISTINCT l_orderkey // 2000 AS sheet, l_orderkey % 2000 + 1 AS "row", l_linenumber AS col FROM lineitem WHERE l_quantity > 20),
t AS (SELECT s_suppkey AS table_id, s_suppkey // 14 AS sheet, s_suppkey * 19 % 1990 + 2 AS header_row, s_suppkey % 4 + 1 AS min_col, s_suppkey % 4 + 5 AS max_col FROM supplier),
f AS (SELECT table_id, min_col, max_col, count(c.col) AS filled FROM t LEFT JOIN cells c ON t.sheet = c.sheet AND c."row" = header_row - 1 AND col BETWEEN min_col AND max_col GROUP BY ALL)
SELECT table_id, filled, filled / (max_col - min_col + 1) >= 0.35 AS visual FROM f
""")
def visual_headers(spark, sf_dir):
    key = F.col("l_orderkey")
    cells = _t(spark, sf_dir, "lineitem").select(F.floor(key / 2000).alias("sheet"), (key % 2000 + 1).alias("row"), F.col("l_linenumber").alias("col"), F.when(F.col("l_quantity") > 20, F.col("l_returnflag")).otherwise("").alias("value"))
    k = F.col("s_suppkey")
    tables = _t(spark, sf_dir, "supplier").select(k.alias("table_id"), F.floor(k / 14).alias("sheet"), (k * 19 % 1990 + 2).alias("header_row"), (k % 4 + 1).alias("min_col"), (k % 4 + 5).alias("max_col"))
    return V.visual_headers(tables, cells)


@query("""
SELECT p_partkey AS path, 'B1' AS rule, 1 AS n FROM part WHERE p_size % 4 = 1
UNION ALL SELECT p_partkey, 'B2', 1 FROM part WHERE p_size % 4 = 2
UNION ALL SELECT p_partkey, 'B3', 2 FROM part WHERE p_size % 4 = 3
""")
def encoding_faults(spark, sf_dir):
    case, name = F.col("p_size") % 4, F.encode("p_name", "UTF-8")
    content = F.when(case == 1, F.concat(F.unhex(F.lit("EFBBBF")), name)).when(case == 2, F.concat(name, F.unhex(F.lit("C328")))).when(case == 3, F.concat(F.unhex(F.lit("01")), name, F.unhex(F.lit("0A7F")))).otherwise(name)
    return V.encoding_faults(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), content.alias("content")))


@query("""
SELECT p_partkey AS doc_id, 'D1' AS rule, 'img/a.png' AS detail FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'D2', 'b c.md' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'E2', '_x000D_' FROM part
""")
def link_faults(spark, sf_dir):
    text = F.concat(F.lit("# "), "p_name", F.lit("\n\n![a](img/a.png) and [b](<b c.md#top>), [web](https://example.com), [here](#up) _x000D_\n\n```\n[code](lost.md) _x000D_\n```\n"))
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("unit"), text.alias("text"))
    assets = part.filter("doc_id % 3 <> 0").select("doc_id", F.lit("img/a.png").alias("name")).unionByName(part.filter("doc_id % 2 <> 0").select("doc_id", F.lit("b c.md").alias("name")))
    return V.link_faults(D.parse_blocks(part), assets)


@query("""
WITH e AS (SELECT 'F' || n_regionkey + 1 || '.' || lpad(CAST(k AS VARCHAR), 2, '0') AS id FROM (SELECT DISTINCT n_regionkey FROM nation), range(1, 7) r(k)),
f AS (SELECT 'F' || n_regionkey + 1 || '.' || lpad(CAST(n_nationkey % 7 + 1 AS VARCHAR), 2, '0') AS id FROM nation)
SELECT 'lost' AS side, id FROM (SELECT id FROM e EXCEPT SELECT id FROM f) UNION ALL SELECT 'added', id FROM (SELECT id FROM f EXCEPT SELECT id FROM e)
""")
def tracker_difference(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    found = n.select(F.format_string("F%d.%02d", F.col("n_regionkey") + 1, F.col("n_nationkey") % 7 + 1).alias("id"))
    expected = spark.range(1).select(F.explode(V.phase_ids({f"F{k}": 6 for k in range(1, 6)})).alias("id"))
    return S.difference_both_ways(expected, found, "id")


@query("""
WITH u AS (SELECT l_orderkey AS doc_id, l_linenumber AS unit, min(l_partkey) AS p, bool_or(l_quantity > 10) AS got FROM lineitem GROUP BY 1, 2),
e AS (SELECT doc_id, max(unit) AS n FROM u GROUP BY 1),
x AS (SELECT e.doc_id, r.unit, p, got FROM e, LATERAL (SELECT unnest(range(1, n + 1)) AS unit) r LEFT JOIN u ON u.doc_id = e.doc_id AND u.unit = r.unit)
SELECT doc_id, sha256(string_agg(chr(10) || '---' || chr(10) || chr(10) || '## Página/unidad ' || unit || chr(10) || chr(10) || CASE WHEN got THEN 'part ' || p ELSE '[PENDIENTE: esta unidad no fue recibida.]' END || chr(10), '' ORDER BY unit)) AS markdown_sha256
FROM x GROUP BY doc_id
""")
def render_documents(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("unit")).agg(F.min("l_partkey").alias("p"), F.bool_or(F.col("l_quantity") > 10).alias("got"))
    expected = li.groupBy("doc_id").agg(F.sequence(F.lit(1), F.max("unit")).alias("expected"))
    units = li.filter("got").select("doc_id", "unit", F.concat(F.lit("part "), "p", F.lit("\n")).alias("text"))
    return D.render_units(expected, units).select("doc_id", T.sha256(F.col("markdown")).alias("markdown_sha256"))


@query("""
SELECT c_custkey AS shape_id, c_name AS text FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 4 FROM orders UNION SELECT o_custkey * 6 FROM orders)
""")
def loose_shapes(spark, sf_dir):
    connectors = _t(spark, sf_dir, "orders").select((F.col("o_custkey") * 4).alias("src"), (F.col("o_custkey") * 6).alias("dst"))
    return S.loose_shapes(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shape_id"), F.col("c_name").alias("text")), connectors)


@query("""
SELECT p_partkey AS doc_id, 'p1-b2' AS block_id, 'E3' AS rule FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 'p1-b2', 'E1' FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 'p1-b4', 'E3' FROM part WHERE p_size % 2 = 1 AND p_size % 5 > 0
UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'p1-b4' ELSE 'p1-b5' END, 'A5' FROM part WHERE p_size % 5 = 0
""")
def section_faults(spark, sf_dir):
    even = F.col("p_size") % 2 == 0
    title = F.when(F.col("p_size") % 3 == 0, F.lit("xl/sheet1.xml")).otherwise(F.col("p_name"))
    text = F.concat(F.lit("# Top\n## "), title, F.lit("\n"), F.when(even, "").otherwise("prose\n"), F.lit("## End\n"), F.when(F.col("p_size") % 5 == 0, "```` x\n# no title\n```\n").when(even, "last\n").otherwise(""))
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("unit"), text.alias("text"))
    return V.section_faults(D.parse_blocks(part))


@query("""
WITH v AS (SELECT user_id AS layer, event_id // 40 AS path, event_id AS ord, value AS x, event_id % 100 AS y, CASE WHEN event_id % 4 = 0 THEN event_id % 3 * 0.25 ELSE 0 END AS bulge FROM events),
n AS (SELECT *, lead(ord) OVER w AS nxt, first(ord) OVER w AS head, count(*) OVER (PARTITION BY layer, path) AS k FROM v WINDOW w AS (PARTITION BY layer, path ORDER BY ord)),
p AS (SELECT a.layer, a.path, a.bulge, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS chord
      FROM n a LEFT JOIN n b ON b.ord = coalesce(a.nxt, CASE WHEN a.path % 2 = 0 AND a.k > 2 THEN a.head END)),
s AS (SELECT layer, path, coalesce(sum(CASE WHEN bulge = 0 THEN chord ELSE chord * 2 * atan(bulge) / sin(2 * atan(bulge)) END), 0) AS length FROM p GROUP BY 1, 2)
SELECT layer, round(sum(length), 4) AS length, count(*) AS paths FROM s GROUP BY layer
""")
def polyline_lengths(spark, sf_dir):
    i, path = F.col("event_id"), F.floor(F.col("event_id") / 40)
    bulge = F.when(i % 4 == 0, i % 3 * 0.25).otherwise(0.0)
    vertices = _t(spark, sf_dir, "events").select(F.col("user_id").alias("layer"), path.alias("path"), i.alias("ord"), F.col("value").alias("x"), (i % 100).cast("double").alias("y"), bulge.cast("double").alias("bulge"), (path % 2 == 0).alias("closed"))
    return S.polyline_lengths(vertices).select("layer", F.round("length", 4).alias("length"), "paths")


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'B' ELSE p_name || ' [B]' END AS label, CASE WHEN p_size % 4 = 1 THEN 'Sheet' ELSE replace(p_name, '_', ' ') || ' & — x' END AS heading,
       CASE WHEN p_size % 3 = 0 THEN '' ELSE ' *(oculta)*' END AS mark, 'a &#124; ' || p_name AS cell
FROM part
""")
def sheet_labels(spark, sf_dir):
    size = F.col("p_size")
    name = F.when(size % 4 == 1, F.concat(F.lit("Tabla"), size)).otherwise(F.concat("p_name", F.lit("_&amp;<BR/>x")))
    state = F.when(size % 3 == 0, "visible").when(size % 3 == 1, "hidden")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", T.header_label(F.when(size % 4 == 0, "").otherwise(F.col("p_name")), F.lit(2)).alias("label"), T.table_heading(name, F.lit("Sheet")).alias("heading"),
        T.hidden_mark(state).alias("mark"), T.clean_cell(F.concat(F.lit(" a |\n\t"), "p_name")).alias("cell"),
    )
