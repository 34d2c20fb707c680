"""Named queries over the test tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import documents as D
from quire.operators import library as L
from quire.operators import retrieval as R
from quire.operators import sheets as S
from quire.sources import files, office, pages
from quire.streaming import resumable

from . import books, channels, checks, exports, machines, oracles, packages, queues, samples, structure, upkeep, views_html  # noqa: F401  they register their queries in packages

FLAGSHIP = "retrieval_topk"
QUERY = "the of"
#: A side with more rows than this is not broadcast.
FEW = 200_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the documents that may answer QUERY."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("unit"), "text")
    return D.parse_blocks(R.holding(docs, QUERY))


def retrieval_topk(spark, sf_dir):
    return R.ranked(_blocks(spark, sf_dir), QUERY, 20).select("doc_id", "unit", "block_id", "score")


def retrieval_excerpt_budget(spark, sf_dir):
    return R.consult(_blocks(spark, sf_dir), QUERY, 5, 4000)


def retrieval_intact(spark, sf_dir):
    """Hits in intact documents only; the damaged ones apart."""
    integrity = _t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 11 != 0).alias("integrity_ok"))
    blocks, damaged = R.intact_documents(_blocks(spark, sf_dir), integrity)
    hits = R.ranked(blocks, QUERY, 10).select(F.lit("hit").alias("section"), "doc_id", "score")
    return hits.unionByName(damaged.select(F.lit("damaged").alias("section"), "doc_id", F.lit(None).cast("long").alias("score")))


def unit_search(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    blocks = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("unit"), F.lit(1).alias("block_no"), "text")
    return R.search_units(blocks, "the on").select("doc_id", F.array_join(F.col("units").cast("array<string>"), ",").alias("units"))


def rerank(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("local_rank"), "n_chars")
    scores = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("local_rank"), (F.col("quality") * 2 - F.col("toxic")).alias("score"))
    return R.rerank(docs, scores, 50)


def _markdown(spark, sf_dir):
    """A known unit of every part: heading, prose, list, quote, table and a fence with a heading inside."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    text = F.concat(F.lit("# "), name, F.lit("\nProse of "), name, F.lit(".\n\n- one\n- two\n\n> quoted "), size, F.lit("\n\n| a | b |\n|---|---|\n| "), size, F.lit(" | x |\n\n```\n# no heading\n| no table |\n```\n## End "), size, F.lit("\n"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") + 1).alias("unit"), text.alias("text"))


def block_parse(spark, sf_dir):
    return D.parse_blocks(_markdown(spark, sf_dir)).select("doc_id", "block_id", "kind", F.col("level").cast("int").alias("level"), "text")


def section_tree(spark, sf_dir):
    """Up to twelve headings a part, of ranks that rise, fall, repeat and skip."""
    heads = F.expr("transform(sequence(1, cast(p_size % 12 AS int) + 1), i -> concat(repeat('#', cast((p_partkey * i * i + p_size) % 6 AS int) + 1), ' t', i, '\n', if(i % 2 = 0, 'prose\n', '')))")
    units = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("unit"), F.array_join(heads, "").alias("text"))
    return D.sections(D.parse_blocks(units)).select("doc_id", "level", "title", "ordinal", "parent", "next_section")


def qa_coverage(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("unit"), "l_quantity").dropDuplicates(["doc_id", "unit", "l_quantity"])
    expected = lines.groupBy("doc_id").agg(F.sequence(F.lit(1), F.max("unit")).alias("expected"))
    received = lines.filter("l_quantity > 5").select("doc_id", "unit").distinct()
    return D.coverage(expected, received).select("doc_id", "expected", "received", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"), "errors", "status")


def _flagged(spark, sf_dir):
    mark = F.array(F.lit(" [Verificar cota]"), F.lit(" ![plano](a.png)"), F.lit(" <script>x</script>"), F.lit(" [ilegible] [pendiente: p. 2]"), F.lit(""), F.lit(" javascript:go()"), F.lit(" [sin cache x]"))
    turns = _t(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit"), F.concat(F.coalesce("text", F.lit("")), F.get(mark, (F.col("turn") % 7).cast("int"))).alias("text"))


def qa_flags(spark, sf_dir):
    return D.unit_flags(_flagged(spark, sf_dir))


def mark_counts(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("(?i)\\[(verificar|ilegible|pendiente|sin cach[eé])\\b[^\\]\\n]*\\]"), F.lit(1))
    marks = _flagged(spark, sf_dir).select(F.explode(F.transform(found, F.lower)).alias("mark"))
    return marks.groupBy(F.when(F.col("mark").startswith("sin"), "pendiente").otherwise(F.col("mark")).alias("mark")).agg(F.count(F.lit(1)).alias("n"))


def _queue(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("md", "txt", "docx", "pdf", "dwg", "xlsx")))
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("format"), T.sha256(F.col("text")).alias("sha256"), "source")


def route_plan(spark, sf_dir):
    return L.plan_routes(_queue(spark, sf_dir))


def batch_counts(spark, sf_dir):
    return L.route_counts(L.plan_routes(_queue(spark, sf_dir)))


def origins_dedup(spark, sf_dir):
    return L.origins(_queue(spark, sf_dir)).select("sha256", "files", "first", F.array_join("sources", ",").alias("sources"))


def _artifacts(spark, sf_dir):
    p, i = _t(spark, sf_dir, "pages"), F.col("page_id")
    html, url = T.sha256(F.col("html")), T.sha256(F.col("url"))
    told = F.array(F.struct(F.lit("documento.md").alias("name"), html.alias("sha256")), F.struct(F.lit("document.json").alias("name"), url.alias("sha256")), F.struct(F.lit("verificacion.json").alias("name"), T.sha256(i).alias("sha256")))
    rows = p.select(i.alias("doc_id"), F.inline(told))
    i, name = F.col("doc_id"), F.col("name")
    actual = F.when((i % 17 == 0) & (name == "documento.md"), F.lit("altered")).when((i % 19 == 0) & (name == "document.json"), F.lit(None)).otherwise(F.col("sha256"))
    return rows.withColumn("actual_sha256", actual)


def integrity_report(spark, sf_dir):
    return L.integrity(_artifacts(spark, sf_dir)).select("doc_id", "integrity_ok", F.array_join("damaged", ",").alias("damaged"))


def version_cache_lookup(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("sha256"))
    cache = d.select(F.col("doc_id").alias("id"), "sha256", (F.lit(6) + (F.col("doc_id") % 3 > 0).cast("int")).alias("version"), (F.col("doc_id") * 7 % 1000).alias("updated"))
    intact = d.select("doc_id", (F.col("doc_id") % 11 != 0).alias("integrity_ok"))
    return L.cached(d.select("sha256").distinct(), cache, intact, 7)


def repair_prune_adopt(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id")
    folders = d.filter("doc_id % 10 <> 7").withColumn("integrity_ok", F.col("doc_id") % 11 != 0)
    return L.repair_plan(d.filter("doc_id % 10 <> 3"), folders)


def _failures(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("event_type = 'error'")
    kinds = F.array(*map(F.lit, ("ValueError", "PermissionError", "FileNotFoundError", "RuntimeError")))
    message = F.concat(F.lit("Page  "), F.when(F.col("event_id") % 2 == 0, "Lost").otherwise("lost"), F.lit(" in run "), (F.col("user_id") % 5).cast("string"))
    return e.select("ts", "user_id", F.concat(F.lit("op"), (F.col("user_id") % 7).cast("string")).alias("operation"), F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("error_type"), message.alias("message"))


def failure_groups(spark, sf_dir):
    found = L.group_failures(_failures(spark, sf_dir))
    return found.withColumn("cause", L.classify_error(F.col("error_type")))


def failure_reopen(spark, sf_dir):
    events = _failures(spark, sf_dir).withColumns({"operation": F.col("user_id").cast("string"), "error_type": F.lit("E"), "message": F.lit("m")})
    solved = _t(spark, sf_dir, "events").filter("event_type = 'signup'").select(T.failure_signature(F.col("user_id").cast("string"), F.lit("E"), F.lit("m")).alias("signature"), F.col("ts").alias("resolved_at"))
    return L.group_failures(events, solved).select("operation", "occurrences", "first_seen", "last_seen", "resolved_at", "resolutions", "status")


def _calls(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("batch"), F.col("event_id").alias("position"), (F.col("event_type") != "click").cast("int").alias("calls"), F.when((F.col("event_type") == "view") & (F.col("event_id") % 9 == 0), None).otherwise(F.floor("value")).cast("long").alias("tokens"))


def ai_budget(spark, sf_dir):
    return L.budget_summary(L.run_budget(_calls(spark, sf_dir), 20, 900))


def token_normalise(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    counted = F.when(F.col("event_id") % 3 == 0, None).otherwise(k - 50)
    e = _t(spark, sf_dir, "events")
    total = L.reported_tokens(counted, F.when(F.col("event_id") % 5 == 0, None).otherwise(k))
    return e.select("event_type", total.alias("tokens")).groupBy("event_type").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("unknown"), F.count(F.lit(1)).alias("runs"))


def status_machine(spark, sf_dir):
    states = F.array(*map(F.lit, ("terminado", "reutilizado", "listo", "bloqueado", "requiere_revision", "terminado", "terminado")))
    lines = _t(spark, sf_dir, "lineitem")
    items = lines.select(F.col("l_orderkey").alias("batch"), F.get(states, (F.col("l_partkey") % 7).cast("int")).alias("state"))
    return L.batch_status(items)


def library_filter(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, "structured_response").otherwise("native")
    catalog = d.select("doc_id", F.concat(F.lit("Report "), "source").alias("title"), F.when(F.col("n_chars") < 500, "parcial").otherwise("revisar").alias("status"), (F.col("doc_id") % 13 != 0).alias("integrity_ok"), kind.alias("input_kind"))
    return L.filter_library(catalog, "REPORT SRC1", "review")


def queue_upsert(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/"), "doc_id").alias("path"), T.sha256(F.col("text")).alias("sha256"))
    old = d.filter("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("doc_id") % 2 == 0, "terminado").otherwise("listo").alias("status"))
    seen = d.filter("doc_id % 6 <> 0").select("path", "sha256", F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("md").alias("format"))
    return L.upsert_queue(old, seen)


def export_names(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    title = F.when(F.col("p_size") % 10 == 0, F.concat("p_name", F.lit(' <a/b>: "c"  '))).when(F.col("p_size") % 10 == 1, F.lit("con.txt")).otherwise(F.col("p_name"))
    return L.export_names(p.select(F.col("p_partkey").alias("doc_id"), title.alias("title")))


def scope_parse(spark, sf_dir):
    n, k = _t(spark, sf_dir, "nation"), F.col("n_nationkey")
    scope = F.when(k % 5 == 4, F.concat(k + 3, F.lit("-"), k)).when(k % 5 == 3, F.concat(k, F.lit(","), k)).otherwise(F.concat(k + 5, F.lit("-"), k + 7, F.lit(", "), k))
    return n.select("n_nationkey", F.array_join(D.parse_scope(scope).cast("array<string>"), ",").alias("units"))


def md_escape(spark, sf_dir):
    p, size = _t(spark, sf_dir, "part"), F.col("p_size")
    begin = F.get(F.array(*map(F.lit, ("# ", "> ", "- ", "12. ", "| ", "=== \n", "<b>", "&amp; ", "plain "))), size % 9)
    raw = F.concat(begin, "p_name", F.lit("\x0b* end | a\\b <script> &lt; "), size.cast("string"))
    return p.select("p_partkey", T.md_text(raw).alias("as_text"), T.md_cell(raw).alias("as_cell"), T.slug(F.concat(F.lit("Ñandú "), "p_name")).alias("slug"))


def _cells(spark, sf_dir):
    """A sheet for every 2,000 orders, a row an order; cells of small quantities are empty."""
    key = F.col("l_orderkey")
    value = F.when(F.col("l_quantity") > 20, F.col("l_returnflag")).otherwise("")
    place = _t(spark, sf_dir, "lineitem").select(F.floor(key / 2000).alias("sheet"), (key % 2000 + 1).alias("row"), F.col("l_linenumber").cast("long").alias("col"), value.alias("value"))
    return place.groupBy("sheet", "row", "col").agg(F.max("value").alias("value"))


def sheet_stats(spark, sf_dir):
    return S.sheet_stats(_cells(spark, sf_dir))


def sheet_regions(spark, sf_dir):
    """Cells outside a declared table of rows 5 to 12, as regions."""
    cells = _cells(spark, sf_dir)
    tables = cells.select("sheet").distinct().withColumns({"min_row": F.lit(5), "max_row": F.lit(12), "min_col": F.lit(1), "max_col": F.lit(4)})
    return S.regions(S.free_cells(cells, tables)).drop("last_row", "last_col")


def grid_render(spark, sf_dir):
    return S.grid_markdown(_cells(spark, sf_dir))


def wide_table_split(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    headers = part.select((F.floor(F.col("p_partkey") / 35)).alias("table_id"), (F.col("p_partkey") % 35 + 1).alias("col"), F.when(F.col("p_size") % 8 == 0, F.concat(F.lit("Columna"), "p_size")).otherwise(F.col("p_name")).alias("header"))
    return S.split_wide(headers)


def wide_table_titles(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    headers = part.select((F.floor(F.col("p_partkey") / 35)).alias("table_id"), (F.col("p_partkey") % 35 + 1).alias("col"), F.when(F.col("p_size") % 8 == 0, F.lit("x")).otherwise(F.col("p_name")).alias("header"))
    return S.group_titles(S.split_wide(headers))


def merge_overlap_join(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    tables = o.select((F.col("o_custkey") % 200).alias("sheet"), F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 30 + 4).alias("min_row"), (F.col("o_orderkey") % 11 + 1).alias("min_col"), (F.col("o_orderkey") % 11 + 6).alias("max_col"))
    s = _t(spark, sf_dir, "supplier")
    merges = s.select((F.col("s_suppkey") % 200).alias("sheet"), F.col("s_name").alias("label"), (F.col("s_suppkey") % 30 + 2).alias("min_row"), (F.col("s_suppkey") % 30 + 2).alias("max_row"), (F.col("s_suppkey") % 9 + 1).alias("min_col"), (F.col("s_suppkey") % 9 + 3).alias("max_col"))
    return S.merged_labels(tables, merges)


def formula_except(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return S.difference_both_ways(li.filter("l_partkey % 7 <> 0"), li.filter("l_partkey % 11 <> 0"), "l_orderkey", "l_linenumber")


def vmerge_fill(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    cells = li.select(F.floor(F.col("l_orderkey") / 20).alias("table_id"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.when(F.col("p") % 3 == 0, F.col("p").cast("string")).alias("text"))
    return S.fill_down(cells)


def page_islands(spark, sf_dir):
    page = F.col("l_linenumber") + F.when(F.col("l_quantity") > 10, 0).otherwise(10)  # gaps
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), page.alias("page"))
    return S.islands(li, "doc_id", "page")


def cad_layer_length(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    bulge = F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 3 * 0.25).otherwise(0.0)
    vertices = e.select(F.col("user_id").alias("layer"), F.col("event_id").alias("ord"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), bulge.cast("double").alias("bulge"))
    return S.path_lengths(vertices).select("layer", F.round("length", 4).alias("length"), "vertices")


def diagram_edges(spark, sf_dir):
    ends = F.array(F.lit("triangle"), F.lit("none"), F.lit(None), F.lit("arrow"), F.lit("diamond"))
    o = _t(spark, sf_dir, "orders")
    connectors = o.select(F.col("o_orderkey").alias("connector_id"), F.col("o_custkey").alias("src"), (F.col("o_custkey") * 3).alias("dst"), F.get(ends, (F.col("o_orderkey") % 5).cast("int")).alias("head"), F.get(ends, (F.col("o_orderkey") % 3).cast("int")).alias("tail"))
    shapes = _t(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("shape_id"), F.concat("c_name", F.lit("\n"), "c_mktsegment").alias("text"))
    return S.diagram_edges(connectors, shapes)


def table_rules(spark, sf_dir):
    """Each part is a document of three table lines; every thirteenth has a broken row, every eleventh no separator."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    rows = F.array(F.lit("| a | b |"), F.when(k % 11 == 0, F.lit("| x | y |")).otherwise(F.lit("|---|---|")), F.when(k % 13 == 0, F.concat(F.lit("| "), "p_name", F.lit(" | c"))).when(k % 7 == 0, F.lit("| \\| | 2 | 3 |")).otherwise(F.lit("| 1 | 2 |")), F.lit("prose"))
    lines = p.select(k.alias("doc_id"), F.posexplode(rows).alias("line_no", "line"))
    return S.table_findings(lines, T.pipe_columns(F.trim("line"))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def marker_antijoin(spark, sf_dir):
    """Benchmark items that no document holds whole, both read as FN-24 does and in lower case."""
    read = F.lower(T.readable(F.col("text")))
    markers = _t(spark, sf_dir, "benchmark").select("item_id", read.alias("marker"))
    docs = _t(spark, sf_dir, "documents").select(read.alias("text"))
    return D.absent_markers(markers, docs, FEW).select("item_id")


def html_blocks(spark, sf_dir):
    return pages.html_blocks(_t(spark, sf_dir, "pages"))


def inventory_sniff(spark, sf_dir):
    return files.sniffed(files.samples(_t(spark, sf_dir, "part")))


def workbook_cells(spark, sf_dir):
    return office.workbook_cells(office.unpacked(samples.workbooks(_t(spark, sf_dir, "part")), "^xl/.*\\.(xml|rels)$"))


def word_paragraphs(spark, sf_dir):
    return office.word_paragraphs(office.unpacked(samples.word_files(_t(spark, sf_dir, "part")), "^word/"))


def word_tables(spark, sf_dir):
    return office.word_tables(office.unpacked(samples.word_files(_t(spark, sf_dir, "part")), "^word/"))


def slide_edges(spark, sf_dir):
    """Shapes are numbered within their slide, so that ends are told by deck, slide and number."""
    found = office.unpacked(samples.presentations(_t(spark, sf_dir, "orders")), "^ppt/slides/")
    at = lambda d, *keys: d.withColumns({k: F.concat_ws("#", F.regexp_extract("path", "([^/.]+)[^/]*$", 1), "slide", k) for k in keys})
    connectors, shapes = office.slide_diagrams(found)
    return S.diagram_edges(at(connectors, "connector_id", "src", "dst"), at(shapes, "shape_id"))


def drawing_edges(spark, sf_dir):
    return office.drawing_edges(office.unpacked(samples.drawings(_t(spark, sf_dir, "orders")), "^visio/pages/"))


def stream_resumable(spark, sf_dir):
    return resumable.run_events(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_topk, retrieval_excerpt_budget, retrieval_intact, unit_search, rerank, block_parse, section_tree, qa_coverage, qa_flags, mark_counts, route_plan, batch_counts, origins_dedup, integrity_report,
        version_cache_lookup, repair_prune_adopt, failure_groups, failure_reopen, ai_budget, token_normalise, status_machine, library_filter, queue_upsert, export_names, scope_parse, md_escape,
        sheet_stats, sheet_regions, grid_render, wide_table_split, wide_table_titles, merge_overlap_join, formula_except, vmerge_fill, page_islands, cad_layer_length, diagram_edges, table_rules,
        marker_antijoin, html_blocks, inventory_sniff, workbook_cells, word_paragraphs, word_tables, slide_edges, drawing_edges, stream_resumable,
    )
}
QUERIES |= packages.QUERIES
ORACLES = oracles.ORACLES | packages.ORACLES
