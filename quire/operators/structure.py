"""The reading view of a workbook: its declared tables, wide ones in groups of columns, and what lies free beside them.

Everything is in long form and joined by equality: a table is a row with its columns as an array, labels above it are
met by the rows they may stand in, and a rectangle's cells by its rows. A sheet's blocks stand in this order: its
notes, its declared tables from top to bottom, its free regions likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ACCENTS, HIDDEN_MARK, PLAIN, clean_cell, column_letter, header_label, helper_header, md_cell, range_ref, table_heading
from quire.session import settled

from .sheets import CHUNK, regions, sheet_stats

#: Words of headings that identify a row, by rank; titles, evidence and confidence as the view tells them.
KEY_WORDS = (("codigo", "id", "numero", "referencia"), ("paquete", "titulo", "nombre", "descripcion"))
NOTES, HELPERS, LISTED, FREE = "Notas y controles del archivo", "Campos técnicos del libro", "Lista ", "Bloque "
BY_HEADER, BY_HELPER, BY_TABLE, BY_REGION = "encabezados de la tabla", "encabezados auxiliares", "tabla nativa del XLSX", "región continua de celdas"
SURE, LIKELY = "alta", "media"
#: Rows above a header in which a merged label may end; a plain label's row above it, and its least length.
ABOVE, PLAIN_ABOVE, PLAIN_LENGTH = 3, 2, 8
#: The share of filled cells that makes the row above a header a second header.
VISUAL = 0.35
TITLE = 78
GROUP = "title string, columns array<bigint>, evidence string"
REPEATED = " · columnas de identificación repetidas para lectura"


def _tables(tables: DataFrame) -> DataFrame:
    """Tables with long corners, their width and their number on the sheet, from the top."""
    order = Window.partitionBy("sheet").orderBy("min_row", "min_col", "max_row", "max_col")
    corners = [F.col(c).cast("long").alias(c) for c in ("min_row", "min_col", "max_row", "max_col")]
    return tables.select("sheet", "name", *corners).withColumns({"table_no": F.row_number().over(order), "width": F.col("max_col") - F.col("min_col") + 1})


def _headed(tables: DataFrame, filled: DataFrame) -> DataFrame:
    """Tables with heads: their columns in order, each with its heading (the letter where it has none) and whether it is a workbook's own."""
    columns = tables.select("sheet", "table_no", F.col("min_row").alias("row"), F.explode(F.sequence("min_col", "max_col")).alias("col"))
    said = columns.join(filled.select("sheet", "row", "col", "said"), ["sheet", "row", "col"], "left").withColumn("header", F.coalesce("said", column_letter(F.col("col"))))
    heads = F.array_sort(F.collect_list(F.struct("col", "header", helper_header(F.col("header")).alias("helper"))))
    return tables.join(said.groupBy("sheet", "table_no").agg(heads.alias("heads")), ["sheet", "table_no"])


def _own(heads: Column, first: Column, last: Column) -> Column:
    """The columns of a stretch that are not a workbook's own."""
    return F.transform(F.filter(heads, lambda h: ~h["helper"] & h["col"].between(first, last)), lambda h: h["col"])


def _merged_groups(headed: DataFrame, filled: DataFrame, merges: DataFrame) -> DataFrame:
    """sheet, table_no and native: the merged labels just above a table, with the columns they cover and their own corners."""
    m = merges.select("sheet", *[F.col(c).cast("long").alias(f"m_{c}") for c in ("min_row", "min_col", "max_row", "max_col")])
    label = filled.select("sheet", F.col("row").alias("m_min_row"), F.col("col").alias("m_min_col"), F.col("said").alias("label"))
    told = m.join(label, ["sheet", "m_min_row", "m_min_col"])
    near = headed.withColumn("m_max_row", F.explode(F.sequence(F.col("min_row") - ABOVE, F.col("min_row") - 1)))
    over = near.join(told, ["sheet", "m_max_row"]).filter("m_max_col >= min_col AND m_min_col <= max_col")
    over = over.withColumn("columns", _own(F.col("heads"), F.greatest("min_col", "m_min_col"), F.least("max_col", "m_max_col"))).filter(F.size("columns") > 0)
    evidence = range_ref(*(F.col(f"m_{c}") for c in ("min_row", "min_col", "max_row", "max_col")))
    group = F.struct("m_min_row", "m_min_col", "m_max_row", "m_max_col", F.col("label").alias("title"), "columns", evidence.alias("evidence"))
    return over.groupBy("sheet", "table_no").agg(F.array_sort(F.collect_list(group)).alias("native"))


def _row_above(headed: DataFrame, filled: DataFrame, above: int) -> DataFrame:
    """sheet, table_no and over: what stands above a table's columns, so many rows above its header."""
    rows = filled.select("sheet", (F.col("row") + above).alias("min_row"), "col", "said")
    over = headed.select("sheet", "table_no", "min_row", "min_col", "max_col").join(rows, ["sheet", "min_row"]).filter("col BETWEEN min_col AND max_col")
    return over.groupBy("sheet", "table_no").agg(F.array_sort(F.collect_list(F.struct("col", F.col("said").alias("title")))).alias("over"))


def _title(columns: Column, heads: Column) -> Column:
    """From the first heading to the last, cut if long."""
    name = lambda c: F.filter(heads, lambda h: h["col"] == c)[0]["header"]
    first, last = name(F.element_at(columns, 1)), name(F.element_at(columns, -1))
    whole = F.when(first == last, first).otherwise(F.concat(first, F.lit(" → "), last))
    return F.when(F.length(whole) <= TITLE, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, TITLE - 3)), F.lit("…")))


def _keys(heads: Column) -> Column:
    """The columns that identify a row: the first with a word of each rank; without any the first that is not a workbook's own, or the first."""
    words = lambda h: F.split(F.lower(F.translate(h["header"], ACCENTS, PLAIN)), r"(?U)[^\w]+")
    ranked = lambda rank: F.filter(heads, lambda h: F.arrays_overlap(words(h), F.array(*map(F.lit, rank))))
    first = F.slice(F.transform(ranked(KEY_WORDS[0]), lambda h: h["col"]), 1, 1)
    second = F.slice(F.array_except(F.transform(ranked(KEY_WORDS[1]), lambda h: h["col"]), first), 1, 1)
    found = F.concat(first, second)
    other = F.transform(F.slice(F.concat(F.filter(heads, lambda h: ~h["helper"]), heads), 1, 1), lambda h: h["col"])
    return F.when(F.size(found) > 0, found).otherwise(other)


def wide_tables(tables: DataFrame, filled: DataFrame, merges: DataFrame) -> DataFrame:
    """Tables of over CHUNK columns with their keys and groups: (title, columns, evidence), by their first column, the workbook's own last.

    Labels above a table group the columns they cover: merged ones that end in the three rows above its header, then
    plain ones two rows above that stand beyond these. What no label covers is cut nine by nine.
    """
    headed = _headed(tables.filter(F.col("width") > CHUNK), filled)
    plain = _row_above(headed, filled, PLAIN_ABOVE).withColumnRenamed("over", "plain")
    visual = _row_above(headed, filled, 1).select("sheet", "table_no", F.size("over").alias("n_above"))
    t = headed
    for more in (_merged_groups(headed, filled, merges), plain, visual):
        t = t.join(more, ["sheet", "table_no"], "left")
    none = F.filter(F.array(F.struct(F.lit("").alias("title"), F.array(F.lit(0).cast("long")).alias("columns"), F.lit("").alias("evidence"))), lambda _: F.lit(False))
    group = lambda title, columns, evidence: F.struct(title.alias("title"), columns.alias("columns"), evidence.alias("evidence"))
    t = t.withColumn("merged", F.coalesce(F.transform("native", lambda g: group(g["title"], g["columns"], g["evidence"])), none))
    t = t.withColumn("claimed", F.flatten(F.transform("merged", lambda g: g["columns"])))
    last = F.coalesce(F.array_max("claimed"), F.col("min_col") - 1)
    beyond = F.filter(F.coalesce("plain", F.array().cast("array<struct<col: bigint, title: string>>")), lambda p: (p["col"] > last) & (F.length(p["title"]) >= PLAIN_LENGTH) & ~F.startswith(p["title"], F.lit("*")))
    place = lambda c: F.concat(column_letter(c), (F.col("min_row") - PLAIN_ABOVE).cast("string"))
    t = t.withColumn("late", F.filter(F.transform(beyond, lambda p: group(p["title"], _own(F.col("heads"), p["col"], F.col("max_col")), place(p["col"]))), lambda g: F.size(g["columns"]) > 0))
    t = t.withColumn("labels", F.filter(beyond, lambda p: F.size(_own(F.col("heads"), p["col"], F.col("max_col"))) > 0))
    t = t.withColumn("claimed", F.concat("claimed", F.flatten(F.transform("late", lambda g: g["columns"]))))
    t = t.withColumn("rest", F.array_except(_own(F.col("heads"), F.col("min_col"), F.col("max_col")), F.col("claimed")))
    cuts = F.when(F.size("rest") > 0, F.sequence(F.lit(0), F.floor((F.size("rest") - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("chunks", F.transform(F.transform(cuts, lambda i: F.slice("rest", i * CHUNK + 1, CHUNK)), lambda c: group(_title(c, F.col("heads")), c, F.lit(BY_HEADER))))
    ordered = F.array_sort(F.transform(F.concat("chunks", "merged", "late"), lambda g, i: F.struct(F.array_min(g["columns"]).alias("at"), i.alias("nth"), g.alias("g"))))
    own = F.transform(F.filter("heads", lambda h: h["helper"]), lambda h: h["col"])
    helpers = F.when(F.size(own) > 0, F.array(group(F.lit(HELPERS), own, F.lit(BY_HELPER)))).otherwise(none)
    t = t.withColumn("groups", F.concat(F.transform(ordered, lambda x: x["g"]), helpers)).withColumn("keys", _keys(F.col("heads")))
    return t.withColumn("visual", F.coalesce("n_above", F.lit(0)) / F.col("width") >= VISUAL).drop("merged", "plain", "late", "claimed", "rest", "chunks", "n_above")


def uncovered_columns(wide: DataFrame) -> DataFrame:
    """sheet, table_no, col of the columns that no group of their table has: none, or the split has lost something."""
    all_ = wide.select("sheet", "table_no", F.explode("heads.col").alias("col"))
    shown = wide.select("sheet", "table_no", F.explode("groups").alias("g")).select("sheet", "table_no", F.explode("g.columns").alias("col"))
    return all_.join(shown, ["sheet", "table_no", "col"], "left_anti")


def _consumed(tables: DataFrame, wide: DataFrame) -> DataFrame:
    """sheet, row, from_col, to_col of the cells that tables and their labels take, row by row."""
    strip = lambda d, first, last, a, b: d.select("sheet", F.explode(F.sequence(first, last)).alias("row"), a.cast("long").alias("from_col"), b.cast("long").alias("to_col"))
    c = F.col
    own = strip(tables, c("min_row"), c("max_row"), c("min_col"), c("max_col"))
    native = wide.select("sheet", F.inline("native"))
    label = wide.select("sheet", (c("min_row") - PLAIN_ABOVE).alias("row"), F.explode("labels.col").alias("col"))
    second = wide.filter("visual AND min_row > 1").withColumn("row", c("min_row") - 1)
    return (
        own.unionByName(strip(native, c("m_min_row"), c("m_max_row"), c("m_min_col"), c("m_max_col")))
        .unionByName(strip(label, c("row"), c("row"), c("col"), c("col")))
        .unionByName(strip(second, c("row"), c("row"), c("min_col"), c("max_col")))
    )


def structure(cells: DataFrame, tables: DataFrame, merges: DataFrame, sheets: DataFrame) -> DataFrame:
    """The blocks of sheets: sheet, nth, part, kind, title, source_ref, confidence, evidence, columns, headers, repeated, items, first_row, last_row.

    cells: sheet, row, col, value; tables: sheet, name and corners; merges: sheet and corners; sheets: sheet, name.
    kind is notes, table, table_group or list. A group's parts follow it (part 1, 2, ...); its data are in first_row
    to last_row. columns are what a table shows, with the keys in front (repeated: those of another part); items are
    a list's texts, or notes as (place, text) in one string. The wide tables, the free cells and their regions are
    written once to the shared folder, since several kinds of blocks are made of them.
    """
    filled = cells.select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), clean_cell(F.col("value")).alias("said")).filter("said <> ''")
    t = _tables(tables).join(sheets.select("sheet", F.col("name").alias("sheet_name")), "sheet", "left").withColumn("title", table_heading(F.col("name"), F.col("sheet_name")))
    wide = settled(wide_tables(t, filled, merges), "wide")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    texts = lambda c, name: c.cast("array<string>").alias(name)
    numbers = lambda c, name: c.cast("array<bigint>").alias(name)
    ref = range_ref(*(F.col(c) for c in ("min_row", "min_col", "max_row", "max_col")))
    at = [F.lit(1).alias("rank"), F.col("min_row").alias("at_row"), F.col("min_col").alias("at_col"), F.col("table_no").alias("at_no")]
    data = [(F.col("min_row") + 1).alias("first_row"), F.col("max_row").alias("last_row")]
    narrow = _headed(t.filter(F.col("width") <= CHUNK), filled).select(
        "sheet", *at, F.lit(0).alias("part"), F.lit("table").alias("kind"), "title", ref.alias("source_ref"), F.lit(SURE).alias("confidence"), F.lit(BY_TABLE).alias("evidence"),
        numbers(F.col("heads.col"), "columns"), texts(F.col("heads.header"), "headers"), numbers(F.array(), "repeated"), none("items", "array<string>"), *data,
    )
    whole = wide.select(
        "sheet", *at, F.lit(0).alias("part"), F.lit("table_group").alias("kind"), "title", ref.alias("source_ref"), F.lit(SURE).alias("confidence"), none("evidence", "string"),
        numbers(F.col("heads.col"), "columns"), none("headers", "array<string>"), none("repeated", "array<bigint>"), none("items", "array<string>"), *data,
    )
    parts = wide.select("*", F.posexplode("groups").alias("pos", "g")).withColumn("shown", F.array_distinct(F.concat("keys", "g.columns")))
    name = lambda c: F.filter("heads", lambda h: h["col"] == c)[0]["header"]
    parts = parts.select(
        "sheet", *at, (F.col("pos") + 1).alias("part"), F.lit("table").alias("kind"), F.col("g.title").alias("title"),
        range_ref(F.col("min_row"), F.array_min("g.columns"), F.col("max_row"), F.array_max("g.columns")).alias("source_ref"),
        F.when(F.col("g.evidence") == BY_HEADER, LIKELY).otherwise(SURE).alias("confidence"), F.col("g.evidence").alias("evidence"),
        numbers(F.col("shown"), "columns"), texts(F.transform("shown", name), "headers"), numbers(F.array_except("keys", "g.columns"), "repeated"), none("items", "array<string>"), *data,
    )
    free = filled.join(_consumed(t, wide).withColumnsRenamed({"sheet": "s_", "row": "r_"}), (F.col("sheet") == F.col("s_")) & (F.col("row") == F.col("r_")) & F.col("col").between(F.col("from_col"), F.col("to_col")), "left_anti")
    free = settled(free, "free")
    found = settled(regions(free.withColumnRenamed("said", "value")).filter("kind <> 'too large'"), "regions")
    single = found.filter("first_col = last_col").withColumn("row", F.explode(F.sequence("first_row", "last_row"))).withColumn("col", F.col("first_col"))
    said = single.join(free, ["sheet", "row", "col"])
    place = [F.lit(2).alias("rank"), F.col("first_row").alias("at_row"), F.col("first_col").alias("at_col"), F.lit(0).alias("at_no"), F.lit(0).alias("part")]
    lists = said.filter("kind = 'list'").groupBy("sheet", "first_row", "first_col", "last_row", "source_ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "said"))), lambda x: x["said"]).alias("items"))
    lists = lists.select(
        "sheet", *place, F.lit("list").alias("kind"), F.concat(F.lit(LISTED), "source_ref").alias("title"), "source_ref", F.lit(LIKELY).alias("confidence"), none("evidence", "string"),
        numbers(F.array("first_col"), "columns"), none("headers", "array<string>"), none("repeated", "array<bigint>"), "items", "first_row", "last_row",
    )
    spread = F.sequence("first_col", "last_col")
    blocks = found.filter("kind = 'table'").select(
        "sheet", *place, "kind", F.concat(F.lit(FREE), "source_ref").alias("title"), "source_ref", F.lit(LIKELY).alias("confidence"), F.lit(BY_REGION).alias("evidence"),
        numbers(spread, "columns"), texts(F.transform(spread, column_letter), "headers"), numbers(F.array(), "repeated"), none("items", "array<string>"), "first_row", "last_row",
    )
    noted = said.filter("kind = 'note'").groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("first_row", "first_col", "source_ref", "said"))).alias("n"))
    notes = noted.select(
        "sheet", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("at_row"), F.lit(0).cast("long").alias("at_col"), F.lit(0).alias("at_no"), F.lit(0).alias("part"), F.lit("notes").alias("kind"), F.lit(NOTES).alias("title"),
        none("source_ref", "string"), F.lit(SURE).alias("confidence"), none("evidence", "string"), none("columns", "array<bigint>"), none("headers", "array<string>"), none("repeated", "array<bigint>"),
        F.transform("n", lambda x: F.concat(F.lit("`"), x["source_ref"], F.lit("` — "), x["said"])).alias("items"), none("first_row", "bigint"), none("last_row", "bigint"),
    )
    every = notes
    for more in (narrow, whole, parts, lists, blocks):
        every = every.unionByName(more)
    nth = F.dense_rank().over(Window.partitionBy("sheet").orderBy("rank", "at_row", "at_col", "at_no"))
    return every.withColumn("nth", nth).drop("rank", "at_row", "at_col", "at_no").select("sheet", "nth", "part", *[c for c in every.columns if c not in ("sheet", "rank", "at_row", "at_col", "at_no", "part")])


def block_lines(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """sheet, nth, part, place, row, line: the Markdown lines of blocks; a table's rows without text are left out.

    Rows are met by (sheet, row): each row's cells are gathered once, whatever the parts that show them.
    """
    c = F.col
    level = F.when(c("part") > 0, "#### ").otherwise("### ")
    quote = F.concat(F.lit("> Tabla original de "), F.size("columns").cast("string"), F.lit(" columnas (`"), "source_ref", F.lit("`). Se divide para lectura; los identificadores se repiten y ninguna columna se descarta."))
    source = F.concat(F.lit("*Fuente: `"), "source_ref", F.lit("` · confianza "), "confidence", F.when(F.size("repeated") > 0, REPEATED).otherwise(""), F.lit(".*"))
    row = lambda texts: F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))
    labels = F.transform(F.arrays_zip("headers", "columns"), lambda x: header_label(x["headers"], x["columns"]))
    table = F.array(source, F.lit(""), row(labels), row(F.transform("headers", lambda _: F.lit("---"))))
    body = (
        F.when(c("kind") == "table_group", F.array(quote)).when(c("kind") == "table", table)
        .otherwise(F.transform("items", lambda x: F.concat(F.lit("- "), x)))
    )
    head = blocks.select("sheet", "nth", "part", F.posexplode(F.concat(F.array(F.concat(level, "title"), F.lit("")), body)).alias("place", "line")).withColumn("row", F.lit(0).cast("long"))
    held = cells.filter(clean_cell(c("value")) != "").groupBy("sheet", c("row").cast("long").alias("row")).agg(F.map_from_entries(F.collect_set(F.struct(c("col").cast("long").alias("col"), md_cell(c("value")).alias("v")))).alias("held"))
    rows = blocks.filter("kind = 'table' AND first_row <= last_row").select("sheet", "nth", "part", "columns", F.explode(F.sequence("first_row", "last_row")).alias("row")).join(held, ["sheet", "row"])
    values = F.transform("columns", lambda k: F.coalesce(F.try_element_at("held", k), F.lit("")))
    told = rows.withColumn("values", values).filter(F.exists("values", lambda v: v != "")).select("sheet", "nth", "part", F.lit(1000).alias("place"), row(c("values")).alias("line"), "row")
    end = blocks.select("sheet", "nth", "part", F.lit(1001).alias("place"), F.lit("").alias("line"), F.lit(0).cast("long").alias("row"))
    return head.unionByName(told).unionByName(end).select("sheet", "nth", "part", "place", "row", "line")


def sheet_sections(blocks: DataFrame, cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """sheet, hidden, markdown: each sheet's section of the reading view; sheets: sheet, name, state.

    A sheet of nothing says so. A section is one row, of at most the reader's million cells.
    """
    lines = block_lines(blocks, cells)
    texts = lines.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "part", "place", "row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    native = blocks.filter("kind IN ('table', 'table_group') AND part = 0 AND (evidence IS NULL OR evidence <> '" + BY_REGION + "')").groupBy("sheet").agg(F.count(F.lit(1)).alias("tables"))
    told = sheets.join(sheet_stats(cells).withColumnsRenamed({"rows": "n_rows", "cols": "n_cols", "cells": "n_cells"}), "sheet", "left").join(native, "sheet", "left").join(texts, "sheet", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    hidden = ~F.col("state").eqNullSafe("visible")
    head = F.concat(
        F.lit("## Hoja: "), "name", F.when(hidden, HIDDEN_MARK).otherwise(""), F.lit("\nfilas "), n("n_rows"), F.lit(" · columnas con dato "), n("n_cols"), F.lit(" · "), n("tables"), F.lit(" tablas nativas\n\n> Rango usado `"),
        F.coalesce("used", F.lit("")), F.lit("` · "), n("n_cells"), F.lit(" celdas con dato.\n\n"), F.coalesce("body", F.lit("*(hoja sin celdas con datos)*\n")),
    )
    return told.select("sheet", hidden.alias("hidden"), head.alias("markdown"))
