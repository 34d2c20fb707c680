"""Operators on spreadsheet cells, tables, drawings and diagrams, all in long form: one row a cell, edge or vertex."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.functions.text import column_letter, connector, helper_header, md_cell, range_ref

from .ranges import HOT, dealt, dealt_to, followed, shuffled, tasks_for

CHUNK = 9
#: Connectors whose ends a task meets with their shapes.
EDGE_ROWS = 100_000
#: Fixed value: cells of a sheet beyond which it is not read.
MOST_CELLS = 1_000_000
SEPARATOR = "^\\|(?:\\s*:?-+:?\\s*\\|)+$"


def sheet_stats(cells: DataFrame) -> DataFrame:
    """Per sheet: rows and columns with data, non-empty cells, used range."""
    full = cells.filter(F.length(F.trim("value")) > 0)
    corners = [F.min("row"), F.min("col"), F.max("row"), F.max("col")]
    return full.groupBy("sheet").agg(
        F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("cols"), F.count(F.lit(1)).alias("cells"), range_ref(*corners).alias("used"),
    )


def free_cells(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells that lie in none of their sheet's declared tables: a range anti join, tables told by sheet."""
    t = tables.select(F.col("sheet").alias("_s"), "min_row", "max_row", "min_col", "max_col")
    return cells.join(t, (F.col("sheet") == F.col("_s")) & F.col("row").between(F.col("min_row"), F.col("max_row")) & F.col("col").between(F.col("min_col"), F.col("max_col")), "left_anti")


def _label(rows: pd.Series, cols: pd.Series) -> list[int]:
    """Smallest cell number of each cell's region, by union of neighbours above and to the left."""
    at = {rc: k for k, rc in enumerate(zip(rows, cols, strict=True))}
    up = list(range(len(at)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for (r, c), k in at.items():
        for near in ((r - 1, c), (r, c - 1)):
            if near in at:
                a, b = sorted((top(k), top(at[near])))
                up[b] = a
    return [top(k) for k in at.values()]


def regions(cells: DataFrame) -> DataFrame:
    """Connected regions (4 neighbours) of non-empty cells, one sheet a group of at most MOST_CELLS cells, the reader's limit.

    sheet, source_ref, kind (note, list or table), cells, first_row, first_col, last_row, last_col. A sheet of more
    cells is not read: it is one row of kind `too large`.
    """

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"]).drop_duplicates(["row", "col"]).reset_index(drop=True)
        return frame.assign(region=_label(frame["row"], frame["col"]))[["sheet", "row", "col", "region"]]

    key = StructField("sheet", cells.schema["sheet"].dataType)
    places = StructType([key] + [StructField(c, LongType()) for c in ("row", "col", "region")])
    full = cells.filter(F.length(F.trim("value")) > 0).select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    large = full.groupBy("sheet").agg(F.count(F.lit(1)).alias("cells")).filter(F.col("cells") > MOST_CELLS)
    labelled = full.join(large, "sheet", "left_anti").groupBy("sheet").applyInPandas(label, places)
    corners = labelled.groupBy("sheet", "region").agg(F.min("row").alias("r1"), F.min("col").alias("c1"), F.max("row").alias("r2"), F.max("col").alias("c2"), F.count(F.lit(1)).alias("cells"))
    kind = F.when(F.col("cells") == 1, "note").when(F.col("c1") == F.col("c2"), "list").otherwise("table")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    refused = large.select("sheet", none("source_ref", "string"), F.lit("too large").alias("kind"), "cells", *[none(c, "bigint") for c in ("first_row", "first_col", "last_row", "last_col")])
    return corners.select("sheet", range_ref(*(F.col(c) for c in ("r1", "c1", "r2", "c2"))).alias("source_ref"), kind.alias("kind"), "cells", F.col("r1").alias("first_row"), F.col("c1").alias("first_col"), F.col("r2").alias("last_row"), F.col("c2").alias("last_col")).unionByName(refused)


def split_wide(headers: DataFrame) -> DataFrame:
    """Columns (table_id, col, header) of wide tables with their reader group: nine by nine, workbook helpers last."""
    helper = helper_header(F.col("header"))
    nth = F.row_number().over(Window.partitionBy("table_id", "helper").orderBy("col")) - 1
    out = headers.withColumn("helper", helper).withColumn("chunk", F.when(F.col("helper"), -1).otherwise(F.floor(nth / CHUNK)).cast("int"))
    return out.select("table_id", "col", column_letter(F.col("col")).alias("letter"), "header", "helper", "chunk")


def group_titles(split: DataFrame) -> DataFrame:
    """Per table and chunk: its columns and a title from its first heading to its last."""
    first, last = F.min_by("header", "col"), F.max_by("header", "col")
    return split.groupBy("table_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.when(first == last, first).otherwise(F.concat(first, F.lit(" → "), last)).alias("title"))


def merged_labels(tables: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged ranges just above a table's header (at most three rows) with the table columns they cover.

    A range is met by the row it ends in: the join is by sheet and row, however many there are on a sheet.
    """
    m = merges.select(F.col("sheet").alias("_s"), "label", F.col("max_row").alias("_last"), F.col("min_col").alias("m_min"), F.col("max_col").alias("m_max"))
    near = tables.withColumn("_above", F.explode(F.sequence(F.col("min_row") - 3, F.col("min_row") - 1)))
    over = (F.col("m_max") >= F.col("min_col")) & (F.col("m_min") <= F.col("max_col"))
    found = near.join(m, (F.col("sheet") == F.col("_s")) & (F.col("_above") == F.col("_last")) & over)
    return found.select("sheet", "table_id", "label", F.greatest("min_col", "m_min").alias("from_col"), F.least("max_col", "m_max").alias("to_col"))


def difference_both_ways(source: DataFrame, found: DataFrame, *key: str) -> DataFrame:
    """Rows of the key that only one side has: side and key. One pass over both: a key tells which sides it was seen on."""
    sides = source.select(*key, F.lit(1).alias("_seen")).unionByName(found.select(*key, F.lit(2).alias("_seen")))
    seen = dealt(sides, *key).groupBy(*key).agg(F.bit_or("_seen").alias("_seen")).filter("_seen < 3")
    return seen.select(F.when(F.col("_seen") == 1, "lost").otherwise("added").alias("side"), *key)


def grid_markdown(cells: DataFrame) -> DataFrame:
    """sheet, row, markdown: each row's cells in order as a Markdown table row, gaps kept empty up to the sheet's last column."""
    width = cells.groupBy("sheet").agg(F.max("col").alias("width"))
    held = cells.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_set(F.struct("col", md_cell(F.col("value")).alias("v")))).alias("held"))
    texts = F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.try_element_at("held", c), F.lit("")))
    return held.join(width, "sheet").select("sheet", "row", F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |")).alias("markdown"))


def fill_down(cells: DataFrame) -> DataFrame:
    """Cells (table_id, row, col, text) with null texts filled from the nearest above in their column."""
    above = Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("filled", F.last("text", ignorenulls=True).over(above))


def islands(numbers: DataFrame, group: str, number: str) -> DataFrame:
    """Runs of consecutive numbers in each group: group, first, last, n."""
    own = numbers.select(group, number).distinct()
    run = F.col(number) - F.row_number().over(Window.partitionBy(group).orderBy(number))
    return own.withColumn("run", run).groupBy(group, "run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def path_lengths(vertices: DataFrame, most: int = HOT) -> DataFrame:
    """layer, length: polylines (layer, ord, x, y, bulge) by layer; a bulge makes the piece to the next vertex an arc.

    A layer of more than most vertices is measured in stretches; the last vertex of a stretch is followed by the first
    of the layer's next one.
    """
    rows = followed(vertices, "layer", "ord", ["x", "y"], most)
    chord = F.hypot(F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y"))
    angle = 4 * F.atan(F.abs("bulge"))
    piece = F.when(F.coalesce("bulge", F.lit(0.0)) == 0, F.col("chord")).otherwise(F.col("chord") * angle / (2 * F.sin(angle / 2)))
    return rows.withColumn("chord", chord).groupBy("layer").agg(F.coalesce(F.sum(piece), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("vertices"))


def polyline_lengths(vertices: DataFrame) -> DataFrame:
    """layer, length, paths of vertices (layer, path, ord, x, y, bulge, closed), windows over one polyline each.

    A closed polyline of over two vertices returns to its first; a bulge makes the piece to the next vertex an arc.
    """
    whole = Window.partitionBy("layer", "path")
    by = whole.orderBy("ord")
    returns = F.coalesce(F.col("closed"), F.lit(False)) & (F.count(F.lit(1)).over(whole) > 2)
    following = lambda c: F.coalesce(F.lead(c).over(by), F.when(returns, F.first(c).over(by)))
    chord = F.hypot(following("x") - F.col("x"), following("y") - F.col("y"))
    half = 2 * F.atan(F.abs(F.coalesce("bulge", F.lit(0.0))))
    piece = F.when(F.sin(half) == 0, F.col("chord")).otherwise(F.col("chord") * half / F.sin(half))
    paths = vertices.withColumn("chord", chord).groupBy("layer", "path").agg(F.coalesce(F.sum(piece), F.lit(0.0)).alias("length"))
    return paths.groupBy("layer").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("paths"))


def diagram_edges(connectors: DataFrame, shapes: DataFrame) -> DataFrame:
    """connector_id and its reading: ends told by their shapes' first lines (60 characters), or `figura n`."""
    name = lambda c: F.substring(F.split_part(c, F.lit("\n"), F.lit(1)), 1, 60)
    side = lambda k: shapes.select(F.col("shape_id").alias(k), name(F.col("text")).alias(f"{k}_text"))
    tasks = tasks_for(connectors.count(), EDGE_ROWS)
    both = dealt_to(connectors, tasks, "src").join(shuffled(side("src")), "src", "left")
    both = dealt_to(both, tasks, "dst").join(shuffled(side("dst")), "dst", "left")
    return both.select("connector_id", edge_text().alias("edge"))


def edge_text() -> Column:
    """The reading of a connector (head, tail, src, dst) whose ends are told (src_text, dst_text), or else are `figura n`."""
    end = lambda k: F.coalesce(F.nullif(f"{k}_text", F.lit("")), F.concat(F.lit("figura "), F.col(k)))
    return connector(F.col("head"), F.col("tail"), end("src"), end("dst"))


def loose_shapes(shapes: DataFrame, connectors: DataFrame) -> DataFrame:
    """Shapes with text that are an end of no connector."""
    used = connectors.select(F.col("src").alias("shape_id")).unionByName(connectors.select(F.col("dst").alias("shape_id"))).distinct()
    return shapes.filter(F.length(F.trim("text")) > 0).join(used, "shape_id", "left_anti")


def table_findings(lines: DataFrame, columns: Column) -> DataFrame:
    """Errors of pipe tables in lines (doc_id, line_no, line): A1 no closing pipe, A2 wrong number of cells, A4 no separator.

    columns: the number of cells of `line`. Tables are runs of lines that begin with a pipe.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    own = lines.withColumn("is_row", F.startswith(F.ltrim("line"), F.lit("|"))).withColumn("run", F.sum((~F.col("is_row")).cast("int")).over(order)).filter("is_row")
    rows = own.withColumn("width", columns).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("line_no")))
    head = F.first("width").over(Window.partitionBy("doc_id", "run").orderBy("line_no"))
    second = F.lead("line").over(Window.partitionBy("doc_id", "run").orderBy("line_no"))
    rows = rows.withColumns({"expected": head, "second": second})
    rules = F.array_compact(F.array(
        F.when(~F.endswith(F.rtrim("line"), F.lit("|")) | (F.trim("line") == "|"), "A1"),
        F.when((F.col("nth") > 1) & (F.col("width") != F.col("expected")), "A2"),
        F.when((F.col("nth") == 1) & ~F.coalesce(F.rlike(F.trim("second"), F.lit(SEPARATOR)), F.lit(False)), "A4"),
    ))
    return rows.select("doc_id", "line_no", F.explode(rules).alias("rule"))
