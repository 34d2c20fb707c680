"""What readers of converted documents see: shapes of tables, drawings' summaries, page choices and text rules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import cad_text
from quire.operators.documents import FENCE, HEADING

#: Columns from which a table is wide, the least share of a header row, and what makes a page graphic.
WIDE, HEADER_SHARE, FEW_CHARS, MANY_GRAPHICS = 12, 0.35, 150, 6
#: Control characters that a text may not hold, raw escapes, and links of Markdown.
FORBIDDEN, RAW_ESCAPE, LINK = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\ufffe\\uffff]", "_x[0-9A-Fa-f]{4}_", "(!?)\\[[^\\]]*\\]\\(<?([^)>]+)>?\\)"

#: Folders and parts within packages, which no title should show; numbered ones and files in their own lists.
PACKAGE_NAMES, NUMBERED_NAMES, PACKAGE_FOLDERS, PART_ENDING = ("OEBPS", "OPS", "_template", "x_template"), ("Part", "rId"), ("ppt", "visio", "word", "xl"), ".xml"


def internal_name(title: Column) -> Column:
    """Whether a title shows a package's inner name, as a word of its own (whatever the case; a slash may stand before it)."""
    any_of = lambda names: "|".join(map(re.escape, names))
    word = f"(?:{any_of(PACKAGE_NAMES)}|(?:{any_of(NUMBERED_NAMES)})\\d+|(?:{any_of(PACKAGE_FOLDERS)})/\\S*|\\S+{re.escape(PART_ENDING)})"
    return F.rlike(title, F.lit(f"(?i)(?<![^\\s/]){word}(?!\\S)"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def table_shape(text: Column) -> Column:
    """rows, width, wide, empty_percent, empty_columns of a pipe table: the lines are cut once, and one fold over the rows marks the columns in use."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    cut = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), "^\\||\\|$", ""), "\\|", -1), lambda c: F.trim(c)))
    rule = lambda cells: F.coalesce(F.forall(F.get(cells, F.lit(1)), lambda c: F.rlike(c, F.lit("^:?-{2,}:?$"))), F.lit(False))

    def of(t: Column) -> Column:
        rows, width = t["rows"], t["width"]
        filled = F.aggregate(rows, F.lit(0), lambda n, row: n + F.size(F.filter(row, lambda c: c != "")))
        used = F.aggregate(rows, F.array_repeat(F.lit(False), width), lambda seen, row: F.transform(seen, lambda v, i: v | (F.coalesce(F.get(row, i), F.lit("")) != "")))
        total = width * F.size(rows)
        return F.struct(
            F.size(rows).alias("rows"), width.alias("width"), (width > WIDE).alias("wide"),
            F.bround(100 * (total - filled) / F.greatest(total, F.lit(1))).cast("long").alias("empty_percent"), F.size(F.filter(used, lambda v: ~v)).alias("empty_columns"),
        )

    def body(cells: Column) -> Column:
        without = lambda ruled: F.filter(cells, lambda row, i: ~(ruled & (i == 1)))  # noqa: E731  the rule's row is not shown
        rows = lambda ruled: F.when(ruled, F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0)))).otherwise(cells)
        parts = lambda ruled: F.struct(rows(ruled).alias("rows"), F.coalesce(F.array_max(F.transform(without(ruled), F.size)), F.lit(0)).alias("width"))
        return _bound(rule(cells), lambda ruled: _bound(parts(ruled), of))

    return _bound(cut, body)


def drawing_summary(entities: DataFrame, blocks: int = 25, texts: int = 120) -> DataFrame:
    """section, name, n of entities (ord, kind, block, text): kinds, the most frequent blocks, the first texts that hold a word."""
    count = F.count(F.lit(1)).alias("n")
    kinds = entities.groupBy(F.col("kind").alias("name")).agg(count).select(F.lit("kind").alias("section"), "name", "n")
    used = entities.filter("block IS NOT NULL").groupBy(F.col("block").alias("name")).agg(count).orderBy(F.desc("n"), "name").limit(blocks)
    words = entities.select("ord", cad_text(F.col("text")).alias("name")).filter(F.rlike("name", F.lit("\\p{L}{2,}")))
    first = words.groupBy("name").agg(count, F.min("ord").alias("at")).orderBy("at", "name").limit(texts)
    return kinds.unionByName(used.select(F.lit("block").alias("section"), "name", "n")).unionByName(first.select(F.lit("text").alias("section"), "name", "n"))


def dimension_text(text: Column, measure: Column) -> Column:
    """A dimension's visible text: `<>` is its measure (four decimals at most, `?` if none), `.` alone hides it."""
    value = F.coalesce(F.regexp_replace(F.regexp_replace(F.format_string("%.4f", measure), "0+$", ""), "\\.$", ""), F.lit("?"))
    value = F.when(measure.isNull(), "?").otherwise(value)
    raw = F.coalesce(text, F.lit(""))
    return F.when(F.trim(raw) == ".", "").otherwise(cad_text(F.when(F.contains(raw, F.lit("<>")), F.replace(raw, F.lit("<>"), value)).when(raw == "", value).otherwise(raw)))


def vision_pages(units: DataFrame) -> DataFrame:
    """Units (doc_id, unit, image, characters, graphics) with an image whose own text is poor or which are mostly graphics."""
    poor = (F.coalesce("characters", F.lit(0)) < FEW_CHARS) | (F.coalesce("graphics", F.lit(0)) >= MANY_GRAPHICS)
    return units.filter(F.col("image").isNotNull() & poor).select("doc_id", "unit")


def visual_headers(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, filled, visual: whether the row above a table's header (sheet, header_row, min_col, max_col) is filled enough to be one."""
    c = cells.filter(F.length(F.trim("value")) > 0).select(F.col("sheet").alias("_s"), F.col("row").alias("_r"), F.col("col").alias("_c")).distinct()
    over = (F.col("sheet") == F.col("_s")) & (F.col("header_row") - 1 == F.col("_r")) & F.col("_c").between(F.col("min_col"), F.col("max_col"))
    filled = tables.join(c, over, "left").groupBy("table_id", "min_col", "max_col").agg(F.count("_c").alias("filled"))
    return filled.select("table_id", "filled", (F.col("filled") / F.greatest(F.col("max_col") - F.col("min_col") + 1, F.lit(1)) >= HEADER_SHARE).alias("visual"))


def encoding_faults(files: DataFrame) -> DataFrame:
    """path, rule, n of files (path, content: binary): B1 byte order mark, B2 not UTF-8, B3 control characters (counted)."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    faults = F.array(
        F.struct(F.lit("B1").alias("rule"), (F.hex(F.substring("content", 1, 3)) == "EFBBBF").cast("int").alias("n")),
        F.struct(F.lit("B2").alias("rule"), (~valid).cast("int").alias("n")),
        F.struct(F.lit("B3").alias("rule"), F.when(valid, F.regexp_count(text, F.lit(FORBIDDEN))).otherwise(0).alias("n")),
    )
    return files.select("path", F.inline(faults)).filter("n > 0")


def link_faults(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id, rule, detail: D1 images and D2 links of blocks to no asset (doc_id, name), E2 raw escapes; code is left alone."""
    prose = blocks.filter("kind <> 'code'").select("doc_id", "text")
    targets = F.arrays_zip(F.regexp_extract_all("text", F.lit(LINK), F.lit(1)).alias("bang"), F.regexp_extract_all("text", F.lit(LINK), F.lit(2)).alias("target"))
    links = prose.select("doc_id", F.inline(targets)).withColumn("name", F.split_part("target", F.lit("#"), F.lit(1)))
    local = links.filter((F.col("name") != "") & ~F.rlike("name", F.lit("(?i)^[a-z][a-z0-9+.-]*:")))
    lost = local.join(assets, ["doc_id", "name"], "left_anti").select("doc_id", F.when(F.col("bang") == "!", "D1").otherwise("D2").alias("rule"), F.col("name").alias("detail"))
    raw = prose.select("doc_id", F.lit("E2").alias("rule"), F.explode(F.regexp_extract_all("text", F.lit(RAW_ESCAPE), F.lit(0))).alias("detail"))
    return lost.unionByName(raw)


def section_faults(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, rule of parsed blocks: A5 a fence that stays open, E1 a title with a package's inner name, E3 an empty section.

    A section is empty if a heading of its own or a higher rank, or the document's end, follows it at once.
    """
    full = blocks.filter(F.length(F.trim(F.regexp_replace("text", "(?U)\\s+", ""))) > 0)
    order = Window.partitionBy("doc_id").orderBy("unit", "block_no")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    start, end = F.regexp_extract("text", FENCE, 1), F.regexp_extract(F.element_at(lines, -1), "^ {0,3}(`{3,}|~{3,})\\s*$", 1)
    shut = (F.size(lines) > 1) & (F.substring(start, 1, 1) == F.substring(end, 1, 1)) & (F.length(end) >= F.length(start))
    heading, fenced = F.col("kind") == "heading", (F.col("kind") == "code") & (start != "")
    seen = full.withColumns({"next_kind": F.lead("kind").over(order), "next_level": F.lead("level").over(order)})
    empty = F.col("next_kind").isNull() | ((F.col("next_kind") == "heading") & (F.col("next_level") <= F.col("level")))
    title = F.trim(F.regexp_replace(F.regexp_replace("text", HEADING, ""), "\\s+", " "))
    rules = F.array_compact(F.array(F.when(fenced & ~shut, "A5"), F.when(heading & internal_name(title), "E1"), F.when(heading & empty, "E3")))
    return seen.select("doc_id", "block_id", F.explode(rules).alias("rule"))


def phase_ids(expected: dict[str, int]) -> Column:
    """The ids of phases with so many tasks each: `F1.01`, `F1.02`, ..."""
    return F.array(*[F.lit(f"{phase}.{k:02}") for phase, n in expected.items() for k in range(1, n + 1)])
