"""Office archives: members under a guard, then workbooks, slides, drawings and Word text from their XML on Spark."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import column_letter, ooxml_text
from quire.operators.ranges import dealt, dealt_to, shuffled, tasks_for
from quire.session import settled

from .ooxml import DeckPart, SheetPart, SlidePart, StringsPart, TablePart, WordPart, rows_of

#: What an archive may hold: bytes, entries, bytes of all entries, bytes of one.
MOST_BYTES, MOST_ENTRIES, MOST_TOTAL, MOST_ENTRY = 100_000_000, 20_000, 200_000_000, 50_000_000
#: Members whose rows a task may join or sort.
TASK_MEMBERS = 20_000
NO_CACHE = "[SIN CACHÉ] "
WORD_BODY = "^word/document\\.xml$"
XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}
WORKBOOK = "sheets struct<sheet: array<struct<_name: string, _state: string, _id: string>>>"
RELATIONS = "Relationship array<struct<_Id: string, _Target: string>>"
SHEETS = "^xl/worksheets/[^/]+\\.xml$"
#: A reference within a formula: no part of a longer name, no function.
REFERENCE = r"(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)([1-9][0-9]{0,6})(?![A-Za-z0-9_(])"
NUMBERING = "abstractNum array<struct<_abstractNumId: int, lvl: array<struct<_ilvl: int, numFmt: struct<_val: string>>>>>, num array<struct<_numId: int, abstractNumId: struct<_val: int>>>"


def archive_fault(names: list[str], sizes: list[int], encrypted: bool, size: int) -> str | None:
    """Why an archive is not opened, if so."""
    if size > MOST_BYTES or sum(sizes) > MOST_TOTAL or max(sizes, default=0) > MOST_ENTRY:
        return "too large"
    if len(names) > MOST_ENTRIES:
        return "too many entries"
    if len(set(names)) < len(names):
        return "repeated names"
    return "encrypted" if encrypted else None


class Archive:
    """An archive under the guard: fault says why it is not opened, infos are its entries, read() unpacks one."""

    LOCAL = struct.Struct("<4s22xHH")

    def __init__(self, data: bytes | None):
        self.data, self.infos = data, []
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            infos = self.zip.infolist()
            self.fault = archive_fault([i.filename for i in infos], [i.file_size for i in infos], any(i.flag_bits & 1 for i in infos), len(data))
        except (zipfile.BadZipFile, ValueError, TypeError):
            self.fault = "damaged"
        if not self.fault:
            self.infos = infos
            places = [*sorted(i.header_offset for i in infos), self.zip.start_dir]
            self.ends = dict(zip(places, places[1:], strict=False))

    def read(self, info: zipfile.ZipInfo) -> bytes | None:
        """An entry's content, null if it is damaged."""
        content = self._inflated(info)
        if content is None:
            try:
                content = self.zip.read(info)
            except (zipfile.BadZipFile, ValueError, EOFError, NotImplementedError, zlib.error):
                return None
        return content

    def _inflated(self, info: zipfile.ZipInfo) -> bytes | None:
        """The content of a plain deflated entry that is whole, in one step; null for others, about which zipfile decides."""
        at = info.header_offset
        if info.compress_type != zipfile.ZIP_DEFLATED or info.flag_bits & 0x61 or not 0 <= at <= len(self.data) - self.LOCAL.size:
            return None
        sign, name, extra = self.LOCAL.unpack_from(self.data, at)
        begin = at + self.LOCAL.size
        end = begin + name + extra + info.compress_size
        if sign != b"PK\3\4" or not info.orig_filename.isascii() or self.data[begin : begin + name] != info.orig_filename.encode() or end > self.ends[at]:
            return None
        stream = zlib.decompressobj(-zlib.MAX_WBITS)
        try:
            content = stream.decompress(self.data[end - info.compress_size : end], info.file_size + 1)
        except zlib.error:
            return None
        return content if stream.eof and len(content) == info.file_size and zlib.crc32(content) == info.CRC else None


def _unpacked(data: bytes | None, pattern: re.Pattern) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """member, content and fault of the wanted members, one at a time."""
    archive = Archive(data)
    if archive.fault:
        yield None, None, archive.fault
    for info in archive.infos:
        if pattern.search(info.filename):
            content = archive.read(info)
            yield info.filename, content, "damaged" if content is None else None


def members(archives: DataFrame, wanted: str = ".*") -> DataFrame:
    """path, member, content and fault of archives (path, content): members whose names match, one row each.

    An archive that the guard refuses, or that is damaged or null, is one row with its fault and no member. Only the
    wanted members are unpacked, one at a time. Archives travel as an RDD, whose batches are bounded by bytes.
    """
    pattern = re.compile(wanted)

    def opened(rows: Iterable[tuple[str, bytes | None]]) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
        for path, data in rows:
            for member, content, fault in _unpacked(data, pattern):
                yield path, member, content, fault

    found = archives.select("path", "content").rdd.mapPartitions(opened)
    return archives.sparkSession.createDataFrame(found, "path string, member string, content binary, fault string", verifySchema=False)


def unpacked(archives: DataFrame, wanted: str = ".*") -> DataFrame:
    """members(), written once to the shared folder: for readers that branch, as those of slides, workbooks and books do."""
    return settled(members(archives, wanted), "members")


def tasks_of(found: DataFrame) -> int:
    """Tasks to which the rows of these members are dealt: adaptive execution would merge them by compressed bytes."""
    return tasks_for(found.count(), TASK_MEMBERS)


def _xml(found: DataFrame, member: str, schema: str) -> DataFrame:
    """The members of this name (a pattern) as structs."""
    return found.filter(F.rlike("member", F.lit(member))).select("path", "member", F.from_xml(F.col("content").cast("string"), schema, XML).alias("x"))


def column_number(reference: Column) -> Column:
    """AB12 to 28."""
    letters = F.split(F.regexp_extract(reference, "^([A-Z]{1,3})", 1), "")
    return F.aggregate(letters, F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))


def workbook_sheets(found: DataFrame) -> DataFrame:
    """path, position, sheet, state and member of the sheets of workbooks, out of their members."""
    sheets = _xml(found, "^xl/workbook\\.xml$", WORKBOOK).select("path", F.posexplode("x.sheets.sheet").alias("pos", "s"))
    targets = _xml(found, "^xl/_rels/workbook\\.xml\\.rels$", RELATIONS).select("path", F.inline("x.Relationship"))
    member = F.when(F.startswith("_Target", F.lit("/")), F.substring("_Target", 2, 1 << 30)).otherwise(F.concat(F.lit("xl/"), "_Target"))
    named = targets.select("path", F.col("_Id").alias("rel"), member.alias("member"))
    told = sheets.select("path", (F.col("pos") + 1).alias("position"), F.col("s._name").alias("sheet"), F.coalesce("s._state", F.lit("visible")).alias("state"), F.col("s._id").alias("rel"))
    return told.join(named, ["path", "rel"]).drop("rel")


def _placed(cell: Column) -> list[Column]:
    return [F.regexp_extract(cell, "(\\d+)$", 1).try_cast("int").alias("row"), column_number(cell).alias("col")]


def shifted(formula: Column, rows: Column, columns: Column) -> Column:
    """A formula moved by rows and columns: relative references move along, absolute ones ($) and quoted texts stay."""
    moved = lambda p: F.concat(
        F.when(_part(p, 1) == "$", F.concat(F.lit("$"), _part(p, 2))).otherwise(column_letter(column_number(_part(p, 2)) + columns)),
        F.when(_part(p, 3) == "$", F.concat(F.lit("$"), _part(p, 4))).otherwise((_part(p, 4).try_cast("int") + rows).cast("string")),
        F.split_part(p, F.lit("\u0002"), F.lit(2)),
    )
    marked = lambda piece: F.split(F.regexp_replace(piece, REFERENCE, "\u0001$1|$2|$3|$4\u0002"), "\u0001")
    said = lambda piece: F.array_join(F.transform(marked(piece), lambda p: F.when(F.contains(p, F.lit("\u0002")), moved(p)).otherwise(p)), "")
    return F.array_join(F.transform(F.split(formula, '"'), lambda piece, i: F.when(i % 2 == 0, said(piece)).otherwise(piece)), '"')


def _part(piece: Column, k: int) -> Column:
    return F.split_part(F.split_part(piece, F.lit("\u0002"), F.lit(1)), F.lit("|"), F.lit(k))


def workbook_layers(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two layers of workbooks, (path, member, cell, row, col, ...): formulas (formula), and values (data_type, value).

    A shared formula is written once in its file: the other cells of its range get it moved to their place. Values of
    shared strings are looked up by (path, number); only those cells are part of that join, so that a workbook's others
    stay where they are. Numbers and texts are as written, booleans TRUE or FALSE; a value that is not there is no row.
    """
    rows = rows_of(found, SHEETS, SheetPart).filter("kind = 'cell'").select("path", "member", "cell", *_placed(F.col("cell")), "type", "value", "text", "formula", "shared")
    own = rows.filter("formula <> ''")
    masters = own.filter("shared IS NOT NULL").groupBy("path", "member", "shared").agg(F.min(F.struct("row", "col", "formula")).alias("m"))
    followers = rows.filter("shared IS NOT NULL AND formula = ''").join(masters, ["path", "member", "shared"])
    spread = followers.select("path", "member", "cell", "row", "col", shifted(F.col("m.formula"), F.col("row") - F.col("m.row"), F.col("col") - F.col("m.col")).alias("formula"))
    formulas = own.select("path", "member", "cell", "row", "col", "formula").unionByName(spread)

    plain = F.when(F.col("type") == "b", F.when(F.col("value") == "1", "TRUE").otherwise("FALSE")).when(F.col("type") == "inlineStr", ooxml_text(F.col("text"))).when(F.col("type") == "str", ooxml_text(F.col("value"))).otherwise(F.col("value"))
    direct = rows.filter("type <> 's'").select("path", "member", "cell", "row", "col", F.col("type").alias("data_type"), plain.alias("value"))
    strings = rows_of(found, "^xl/sharedStrings\\.xml$", StringsPart).filter("kind = 'string'").select("path", F.col("nth").alias("n"), ooxml_text(F.col("text")).alias("said"))
    looked = rows.filter("type = 's'").withColumn("n", F.col("value").try_cast("int")).join(strings, ["path", "n"], "left").select("path", "member", "cell", "row", "col", F.col("type").alias("data_type"), F.col("said").alias("value"))
    return formulas, direct.unionByName(looked).filter("value IS NOT NULL AND value <> ''")


def workbook_cells(found: DataFrame) -> DataFrame:
    """path, sheet, state, cell, row, col, data_type, value, formula of the cells that hold something: both layers, met by cell.

    A formula without cached value says so; the cells of a sheet are rows of their own from here on.
    """
    formulas, values = workbook_layers(found)
    both = values.join(formulas, ["path", "member", "cell", "row", "col"], "full_outer")
    value = F.coalesce("value", F.concat(F.lit(NO_CACHE), "formula"))
    cells = both.select("path", "member", "cell", "row", "col", F.coalesce("data_type", F.lit("n")).alias("data_type"), value.alias("value"), "formula")
    return cells.join(workbook_sheets(found), ["path", "member"]).drop("member", "position")


def workbook_refusals(found: DataFrame) -> DataFrame:
    """path, sheet, cells, reason of the sheets that are not read: over the limit of cells, or damaged."""
    rows = rows_of(found, SHEETS, SheetPart).filter("kind IN ('too large', 'damaged')")
    return rows.join(workbook_sheets(found), ["path", "member"]).select("path", "sheet", F.col("value").try_cast("long").alias("cells"), F.col("kind").alias("reason"))


def _corners(ref: Column) -> list[Column]:
    ends = F.split(ref, ":")
    first, last = F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))
    return [x.alias(f"{side}_{name}") for side, end in (("min", first), ("max", last)) for name, x in (("row", F.regexp_extract(end, "(\\d+)$", 1).try_cast("int")), ("col", column_number(F.replace(end, F.lit("$"), F.lit("")))))]


def workbook_merges(found: DataFrame) -> DataFrame:
    """path, sheet, min_row, min_col, max_row, max_col of the merged ranges."""
    refs = rows_of(found, SHEETS, SheetPart).filter("kind = 'merge' AND ref LIKE '%:%'").select("path", "member", *_corners(F.col("ref")))
    return refs.join(workbook_sheets(found), ["path", "member"]).drop("member", "position", "state")


def workbook_tables(found: DataFrame) -> DataFrame:
    """path, sheet, name, min_row, min_col, max_row, max_col of the tables that sheets declare, over the sheets' relations."""
    asked = rows_of(found, SHEETS, SheetPart).filter("kind = 'table'").select("path", "member", "rel")
    related = _xml(found, "^xl/worksheets/_rels/[^/]+\\.xml\\.rels$", RELATIONS).select("path", F.regexp_replace("member", "_rels/|\\.rels$", "").alias("member"), F.inline("x.Relationship"))
    target = F.when(F.startswith("_Target", F.lit("/")), F.substring("_Target", 2, 1 << 30)).otherwise(F.concat(F.lit("xl/"), F.regexp_replace("_Target", "^\\.\\./", "")))
    related = related.select("path", "member", F.col("_Id").alias("rel"), target.alias("part"))
    declared = rows_of(found, "^xl/tables/[^/]+\\.xml$", TablePart).filter("kind = 'declared'").select("path", F.col("member").alias("part"), "name", *_corners(F.col("ref")))
    return asked.join(related, ["path", "member", "rel"]).join(declared, ["path", "part"]).join(workbook_sheets(found), ["path", "member"]).drop("member", "part", "rel", "position", "state")


def _read(text: Column) -> Column:
    """Character data of XML as text: the five entities, ampersands last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _attribute(xml: Column, element: str, name: str) -> Column:
    """An attribute of the first such element, null without it."""
    return F.nullif(F.regexp_extract(xml, f"<{element}\\b[^>]*?\\s{name}=\"([^\"]*)\"", 1), F.lit(""))


def numbered_slides(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (path, member of a slide, ...) with slide: the place in the presentation's own list, over its relations.

    A deck that lists nothing has its slides by the number of their file.
    """
    listed = rows_of(found, "^ppt/presentation\\.xml$", DeckPart).filter("kind = 'slide'").select("path", F.col("nth").alias("slide"), "rel")
    targets = _xml(found, "^ppt/_rels/presentation\\.xml\\.rels$", RELATIONS).select("path", F.inline("x.Relationship"))
    member = F.when(F.startswith("_Target", F.lit("/")), F.substring("_Target", 2, 1 << 30)).otherwise(F.concat(F.lit("ppt/"), "_Target"))
    tasks = tasks_of(found)
    placed = dealt_to(listed, tasks, "path", "rel").join(shuffled(targets.select("path", F.col("_Id").alias("rel"), member.alias("member"))), ["path", "rel"]).drop("rel")
    own = F.regexp_extract("member", "(\\d+)\\.xml$", 1).try_cast("int")
    return dealt_to(rows, tasks, "path", "member").join(shuffled(placed), ["path", "member"], "left").withColumn("slide", F.coalesce("slide", own))


def _slide_rows(found: DataFrame, reader: type[SlidePart] = SlidePart) -> DataFrame:
    return numbered_slides(rows_of(found, "^ppt/slides/[^/]+\\.xml$", reader), found)


def slide_shapes(found: DataFrame) -> DataFrame:
    """path, slide, nth, shape_id, groups, text, hidden: shapes in slide order, those within groups too; slides as the presentation lists them.

    A deck without such a list has its slides by the number of their file. hidden: the slide is not shown.
    """
    return _shapes(_slide_rows(found, SlidePart.only("shape")))


def _shapes(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'shape'").select("path", "slide", "nth", "shape_id", "groups", "text", "hidden")


def slide_connectors(found: DataFrame) -> DataFrame:
    """path, slide, connector_id, src, dst, head, tail, as `diagram_edges` takes them by slide; ends may be shapes within groups."""
    return _connectors(_slide_rows(found, SlidePart.only("connector")))


def _connectors(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'connector'").select("path", "slide", F.col("shape_id").alias("connector_id"), "src", "dst", "head", "tail")


def slide_diagrams(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """slide_connectors and slide_shapes of the same slides, whose parts are read once."""
    rows = settled(_slide_rows(found), "slides")
    return _connectors(rows), _shapes(rows)


def drawing_edges(found: DataFrame) -> DataFrame:
    """path, page, connector_id, src, label, dst of drawings: connectors whose two ends are glued, told by their shapes' texts.

    A shape without text is `[forma n sin texto]`. Ends meet on the connector, texts on page and shape.
    """
    pages = found.filter(F.rlike("member", F.lit("^visio/pages/page\\d+\\.xml$"))).select("path", F.regexp_extract("member", "(\\d+)\\.xml$", 1).cast("int").alias("page"), F.col("content").cast("string").alias("xml"))
    glued = pages.select("path", "page", F.explode(F.regexp_extract_all("xml", F.lit("(<Connect\\b[^>]*>)"), F.lit(1))).alias("c"))
    at = lambda name: _attribute(F.col("c"), "Connect", name)
    glued = glued.select("path", "page", at("FromSheet").try_cast("long").alias("connector_id"), at("FromCell").alias("end"), at("ToSheet").try_cast("long").alias("shape"))
    ends = glued.groupBy("path", "page", "connector_id").agg(F.min(F.when(F.col("end") == "BeginX", F.col("shape"))).alias("a"), F.min(F.when(F.col("end") == "EndX", F.col("shape"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    parts = pages.select("path", "page", F.explode(F.split("xml", "(?=<Shape\\b)")).alias("s")).filter(F.startswith("s", F.lit("<Shape")))
    text = _read(F.regexp_replace(F.regexp_extract("s", "(?s)<Text>(.*?)</Text>", 1), "<[^>]+>", ""))
    texts = parts.select("path", "page", _attribute(F.col("s"), "Shape", "ID").try_cast("long").alias("shape"), F.trim(F.regexp_replace(text, "\\s+", " ")).alias("text"))
    side = lambda k: texts.select("path", "page", F.col("shape").alias(k), F.col("text").alias(f"{k}_text"))
    both = ends.join(side("a"), ["path", "page", "a"], "left").join(side("b"), ["path", "page", "b"], "left").join(side("connector_id"), ["path", "page", "connector_id"], "left")
    name = lambda k: F.coalesce(F.nullif(f"{k}_text", F.lit("")), F.concat(F.lit("[forma "), F.col(k), F.lit(" sin texto]")))
    return both.select("path", "page", "connector_id", name("a").alias("src"), F.coalesce("connector_id_text", F.lit("")).alias("label"), name("b").alias("dst"))


def word_grids(found: DataFrame) -> DataFrame:
    """path, label, parent, row_no, col, text: the cells of Word's tables on their grids, a table within a cell as one of its own.

    label is 2 for the second table of the body and 2.1 for the first within it; parent is the table around it. A cell
    over several columns is repeated in each, columns that a row skips stay empty, and a cell that goes on from above
    has the text of its beginning. Paragraphs of a cell are lines; an inner table is told there by its label.
    """
    cells = settled(rows_of(found, WORD_BODY, WordPart.only("cell")).filter("kind = 'cell'").select("path", "label", "row_no", "col", "span", "goes_on", "text"), "cells")
    columns = F.explode(F.sequence("col", F.col("col") + F.col("span") - 1)).alias("col")
    grid = cells.select("path", "label", "row_no", columns, F.when(~F.col("goes_on"), F.col("text")).alias("text"))
    above = Window.partitionBy("path", "label", "col").orderBy("row_no")
    parent = F.nullif(F.regexp_extract("label", "^(.*)\\.\\d+$", 1), F.lit(""))
    return dealt(grid, "path", "label", "col").select("path", "label", parent.alias("parent"), "row_no", "col", F.coalesce(F.last("text", ignorenulls=True).over(above), F.lit("")).alias("text"))


def word_tables(found: DataFrame) -> DataFrame:
    """path, table_no, row_no, col, text: the tables of Word bodies that stand in no other, as `word_grids` tells them."""
    return word_grids(found).filter("parent IS NULL").select("path", F.col("label").try_cast("int").alias("table_no"), "row_no", "col", "text")


def word_paragraphs(found: DataFrame) -> DataFrame:
    """path, nth, kind (heading, list, cell or paragraph), level, ordered, text, table_no, row_no, cell_no in document order.

    table_no is the outermost table's. List formats come by number and level from the numbering, two lookups by path.
    """
    order = Window.partitionBy("path").orderBy("at")
    rows = rows_of(found, WORD_BODY, WordPart.only("paragraph")).filter("kind = 'paragraph'")
    level = F.regexp_extract(F.coalesce("style", F.lit("")), "(?i)^(?:heading|título|titulo|ttulo)\\s*([1-6])$", 1).try_cast("int")
    own = rows.select(
        "path", F.col("nth").alias("at"), F.col("label").isNotNull().alias("in_table"), F.split_part("label", F.lit("."), F.lit(1)).try_cast("int").alias("table_no"), "row_no", "cell_no",
        level.alias("heading"), "num", F.coalesce("ilvl", F.lit(0)).alias("ilvl"), "text",
    )
    numbering = _xml(found, "^word/numbering\\.xml$", NUMBERING)
    nums = numbering.select("path", F.inline("x.num")).select("path", F.col("_numId").alias("num"), F.col("abstractNumId._val").alias("abstract"))
    levels = numbering.select("path", F.inline("x.abstractNum")).select("path", F.col("_abstractNumId").alias("abstract"), F.explode("lvl").alias("l")).select("path", "abstract", F.col("l._ilvl").alias("ilvl"), F.col("l.numFmt._val").alias("format"))
    out = own.join(nums.join(levels, ["path", "abstract"]).drop("abstract"), ["path", "num", "ilvl"], "left").filter(F.trim(F.regexp_replace("text", "\\s+", "")) != "")
    kind = F.when(F.col("in_table"), "cell").when(F.col("heading").isNotNull(), "heading").when(F.col("num") > 0, "list").otherwise("paragraph")
    only = lambda c: F.when(F.col("in_table"), F.col(c))
    return out.select(
        "path", F.row_number().over(order).alias("nth"), kind.alias("kind"), F.when(kind == "heading", F.col("heading")).when(kind == "list", F.col("ilvl") + 1).alias("level"),
        F.when(kind == "list", F.coalesce("format", F.lit("bullet")) != "bullet").alias("ordered"), "text", only("table_no").alias("table_no"), only("row_no").alias("row_no"), only("cell_no").alias("cell_no"),
    )
