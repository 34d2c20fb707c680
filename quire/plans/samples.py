"""Office archives made of the test tables, with contents that SQL can tell."""

from __future__ import annotations

import struct
import zipfile
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quire.operators.ranges import dealt

#: Rows of a table whose texts a task makes and zips.
TEXT_ROWS = 10_000
HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


#: A member's beginning (names in UTF-8, deflated, of the first of January 1980), its entry and the end of an archive.
MEMBER, ENTRY, END = struct.Struct("<4sHHHHHIIIHH"), struct.Struct("<4sHHHHHHIIIHHHHHII"), struct.Struct("<4sHHHHIIH")
DEFLATED = (20, 0x800, zipfile.ZIP_DEFLATED, 0, 0x21)


def archive(names: list[str], texts: list[bytes]) -> bytes:
    """An archive of deflated members: zipfile, made for large ones, takes three times as long for members of some hundred bytes."""
    out, entries, at = [], [], 0
    for name, text in zip(names, texts, strict=True):
        written, packed = name.encode(), zlib.compress(text, wbits=-zlib.MAX_WBITS)
        told = (zlib.crc32(text), len(packed), len(text), len(written), 0)
        out += (MEMBER.pack(b"PK\3\4", *DEFLATED, *told), written, packed)
        entries += (ENTRY.pack(b"PK\1\2", 20, *DEFLATED, *told, 0, 0, 0, 0, at), written)
        at += MEMBER.size + len(written) + len(packed)
    listed = b"".join(entries)
    return b"".join((*out, listed, END.pack(b"PK\5\6", 0, 0, len(names), len(names), len(listed), at, 0)))


@F.udf(BinaryType(), useArrow=False)
def _zip(names: list[str], texts: list[bytes]) -> bytes:
    return archive(names, texts)


def zipped(names: Column, texts: Column) -> Column:
    """An archive of members with these names and texts; not in Arrow's batches, which would hold thousands of archives' texts."""
    return _zip(names, texts.cast("array<binary>"))


def _archive(parts: dict[str, Column]) -> Column:
    return zipped(F.array(*map(F.lit, parts)), F.array(*parts.values()))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to their archives while they are narrow: their texts are made where the archive is, and don't move."""
    return dealt(rows, key, most=TEXT_ROWS)


def _gathered(table: DataFrame, key: str, order: str, **texts: Column) -> DataFrame:
    """One row a key, each text the concatenation of its rows in order."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), c.alias("t")))), lambda x: x["t"]), "")
    return table.groupBy(key).agg(*[joined(c).alias(k) for k, c in texts.items()])


def _sheaf(table: DataFrame, suffix: str, *parts: tuple[str, Column]) -> DataFrame:
    """path, content: forty orders an archive, a member each for every name (# is the order's number in its archive)."""
    k = F.col("o_orderkey")
    own = F.array(*[F.struct(F.replace(F.lit(name), F.lit("#"), (k % 40 + 1).cast("string")).alias("name"), text.alias("text")) for name, text in parts])
    own_rows = _dealt(table.withColumn("path", F.concat(F.lit("/in/"), F.floor(k / 40).cast("string"), F.lit(suffix))), "path")
    sheaf = own_rows.groupBy("path").agg(F.array_sort(F.flatten(F.collect_list(own))).alias("m"))
    return sheaf.select("path", zipped(F.transform("m", lambda x: x["name"]), F.transform("m", lambda x: x["text"])).alias("content"))


def workbooks(part: DataFrame) -> DataFrame:
    """path, content: forty parts a workbook: a shared string, a number, a formula (every third without cache), a boolean."""
    p = _dealt(part.select(F.concat(F.lit("/in/"), F.floor(F.col("p_partkey") / 40).cast("string"), F.lit(".xlsx")).alias("path"), (F.col("p_partkey") % 40).cast("int").alias("k"), "p_name", F.col("p_size").cast("int").alias("size")), "path")
    rank = F.concat(F.lit("<v>"), F.col("size") * 2, F.lit("</v>"))
    r = (F.col("k") + 1).cast("string")
    row = F.concat(
        F.lit('<row r="'), r, F.lit('"><c r="A'), r, F.lit('" t="inlineStr"><is><r><t>'), F.col("p_name"), F.lit('</t></r><r><t xml:space="preserve"> &amp;_x0041_</t></r></is></c><c r="B'), r, F.lit('"><v>'), F.col("size"),
        F.lit('</v></c><c r="C'), r, F.lit('"><f>B'), r, F.lit("*2</f>"), F.when(F.col("size") % 3 == 0, F.lit("")).otherwise(rank), F.lit('</c><c r="AB'), r, F.lit('" t="b"><v>'), F.col("size") % 2, F.lit("</v></c></row>"),
    )
    shared = F.concat(F.lit('<row r="'), r, F.lit('"><c r="B'), r, F.lit('" t="s"><v>'), (F.row_number().over(Window.partitionBy("path").orderBy("k")) - 1), F.lit("</v></c></row>"))
    p = p.withColumns({"row": row, "ref": shared, "si": F.concat(F.lit("<si><t>"), F.lit("s "), F.col("p_name"), F.lit("</t></si>"))})
    books = _gathered(p, "path", "k", main=F.col("row"), side=F.col("ref"), strings=F.col("si"))
    sheet = lambda c: F.concat(F.lit(HEAD + '<worksheet xmlns="urn:s"><sheetData>'), F.col(c), F.lit('</sheetData><mergeCells count="1"><mergeCell ref="A1:AB1"/></mergeCells></worksheet>'))
    fixed = F.lit(HEAD + '<workbook xmlns="urn:s" xmlns:r="urn:r"><sheets><sheet name="Main" sheetId="1" r:id="rId1"/><sheet name="Side" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>')
    rels = F.lit(HEAD + '<Relationships xmlns="urn:p"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="t" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
    strings = F.concat(F.lit(HEAD + '<sst xmlns="urn:s">'), F.col("strings"), F.lit("</sst>"))
    parts = {"xl/workbook.xml": fixed, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": strings, "xl/worksheets/sheet1.xml": sheet("main"), "xl/worksheets/sheet2.xml": sheet("side")}
    return books.select("path", _archive(parts).alias("content"))


def word_files(part: DataFrame) -> DataFrame:
    """path, content: twenty parts a document: a heading, a numbered item and a table row of three grid columns each."""
    p = _dealt(part.select(F.concat(F.lit("/in/"), F.floor(F.col("p_partkey") / 20).cast("string"), F.lit(".docx")).alias("path"), (F.col("p_partkey") % 20).cast("int").alias("k"), "p_name", F.col("p_size").cast("int").alias("size")), "path")
    run = lambda t: F.concat(F.lit("<w:r><w:t>"), t, F.lit("</w:t></w:r></w:p>"))
    head = F.concat(F.lit('<w:p w:rsidR="0"><w:pPr><w:pStyle w:val="Heading'), F.col("size") % 6 + 1, F.lit('"/></w:pPr>'), run(F.col("p_name")))
    item = F.concat(F.lit('<w:p><w:pPr><w:numPr><w:ilvl w:val="'), F.col("size") % 2, F.lit('"/><w:numId w:val="3"/></w:numPr></w:pPr>'), run(F.concat(F.lit("item &lt;"), F.col("size"), F.lit("&gt;"))))
    goes_on = F.when(F.col("size") % 4 == 0, F.lit("<w:vMerge/>")).otherwise(F.lit('<w:vMerge w:val="restart"/>'))
    row = F.concat(F.lit("<w:tr><w:tc><w:tcPr>"), goes_on, F.lit("</w:tcPr><w:p>"), run(F.concat(F.lit("n"), F.col("size"))), F.lit('</w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p>'), run(F.col("size").cast("string")), F.lit("</w:tc></w:tr>"))
    docs = _gathered(p.withColumns({"a": F.concat(head, item), "r": row}), "path", "k", text=F.col("a"), rows=F.col("r"))
    body = F.concat(F.lit(HEAD + '<w:document xmlns:w="urn:w"><w:body>'), F.col("text"), F.lit("<w:tbl>"), F.col("rows"), F.lit("</w:tbl><w:p/></w:body></w:document>"))
    numbering = F.lit(HEAD + '<w:numbering xmlns:w="urn:w"><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num></w:numbering>')
    return docs.select("path", _archive({"word/document.xml": body, "word/numbering.xml": numbering}).alias("content"))


def presentations(orders: DataFrame) -> DataFrame:
    """path, content: an order a slide, forty a deck, of two shapes (the second sometimes without text) and a connector with ends in turn."""
    k = F.col("o_orderkey")
    ends = F.array(*map(F.lit, ('<a:headEnd type="triangle"/>', '<a:headEnd type="none"/>', "", '<a:headEnd type="arrow"/>')))
    tail = F.when(k % 3 == 0, F.lit('<a:tailEnd type="triangle"/>')).otherwise(F.lit('<a:tailEnd type="none"/>'))
    shape = lambda n, t: F.concat(F.lit(f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="s"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>'), t, F.lit("</a:t></a:r></a:p><a:p><a:r><a:t>more</a:t></a:r></a:p></p:txBody></p:sp>"))
    slide = F.concat(
        F.lit(HEAD + '<p:sld xmlns:p="urn:p" xmlns:a="urn:a">'), shape(2, F.concat(F.lit("c"), F.col("o_custkey"))), F.when(k % 5 != 0, shape(3, F.col("o_orderstatus"))).otherwise(F.lit("")),
        F.lit('<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="4" name="c"/><p:cNvCxnSpPr><a:stCxn id="2" idx="1"/><a:endCxn id="3" idx="0"/></p:cNvCxnSpPr></p:nvCxnSpPr><a:ln>'), F.get(ends, (k % 4).cast("int")), tail, F.lit("</a:ln></p:cxnSp></p:sld>"),
    )
    return _sheaf(orders, ".pptx", ("ppt/slides/slide#.xml", slide))


def drawings(orders: DataFrame) -> DataFrame:
    """path, content: an order a page, forty a drawing: two glued shapes, the second sometimes without text, and a labelled connector."""
    k = F.col("o_orderkey")
    page = F.concat(
        F.lit(HEAD + '<PageContents><Shapes><Shape ID="1" Type="Shape"><Text>c'), F.col("o_custkey"), F.lit('\n</Text></Shape><Shape ID="2">'), F.when(k % 5 != 0, F.concat(F.lit("<Text>"), F.col("o_orderstatus"), F.lit("</Text>"))).otherwise(F.lit("")),
        F.lit('</Shape><Shape ID="3"><Text><cp IX="0"/>'), F.col("o_orderpriority"), F.lit('</Text></Shape></Shapes><Connects><Connect FromSheet="3" FromCell="BeginX" ToSheet="1"/><Connect FromSheet="3" FromCell="EndX" ToSheet="2"/></Connects></PageContents>'),
    )
    return _sheaf(orders, ".vsdx", ("visio/pages/page#.xml", page))


def word_margins(part: DataFrame) -> DataFrame:
    """path, content: twenty parts a document, each with a footnote, a link, a formula and sometimes a comment; one header, an empty footer."""
    k, size = F.col("k"), F.col("size")
    p = _dealt(part.select(F.concat(F.lit("/in/"), F.floor(F.col("p_partkey") / 20).cast("string"), F.lit(".docx")).alias("path"), (F.col("p_partkey") % 20).cast("int").alias("k"), "p_partkey", "p_name", F.col("p_size").cast("int").alias("size")), "path")
    says = lambda t: F.concat(F.lit("<w:p><w:r><w:t>"), t, F.lit("</w:t></w:r></w:p>"))
    math = lambda t: F.concat(F.lit("<m:r><m:t>"), t, F.lit("</m:t></m:r>"))
    note = F.concat(F.lit('<w:footnote w:id="'), k, F.lit('">'), says(F.concat(F.lit("note "), "p_name")), F.lit("</w:footnote>"))
    comment = F.when(size % 3 == 0, F.concat(F.lit('<w:comment w:id="'), k, F.lit('" w:author="A'), size, F.lit('">'), says(F.lit("first")), says(size.cast("string")), F.lit("</w:comment>")))
    link = F.when(k % 4 == 0, F.concat(F.lit('<w:hyperlink w:anchor="a'), size, F.lit('">'))).otherwise(F.concat(F.lit('<w:hyperlink r:id="rId'), k, F.lit('" w:history="1">')))
    power = F.concat(F.lit("<m:sSup><m:e>"), math(F.lit("x")), F.lit("</m:e><m:sup>"), math(k.cast("string")), F.lit("</m:sup></m:sSup>"))
    fraction = F.concat(F.lit("<m:f><m:fPr/><m:num>"), math(size.cast("string")), F.lit("</m:num><m:den>"), power, F.lit("</m:den></m:f>"))
    root = F.concat(F.lit('<m:rad><m:deg/><m:e><m:d><m:dPr><m:begChr m:val="["/></m:dPr><m:e>'), math(F.lit("a")), F.lit("</m:e><m:e>"), math(size.cast("string")), F.lit("</m:e></m:d></m:e></m:rad>"))
    body = F.concat(F.lit("<w:p>"), link, F.lit("<w:r><w:t>see &amp; "), size, F.lit("</w:t></w:r></w:hyperlink><m:oMath>"), F.when(size % 2 == 0, fraction).otherwise(root), F.lit("</m:oMath></w:p>"))
    target = F.when(k % 4 > 0, F.concat(F.lit('<Relationship Id="rId'), k, F.lit('" Type="t" Target="https://x/'), "p_partkey", F.lit('"/>')))
    docs = _gathered(p.withColumns({"n": note, "c": comment, "b": body, "t": target}), "path", "k", notes=F.col("n"), comments=F.col("c"), body=F.col("b"), targets=F.col("t"))
    whole = lambda tag, inside, before="": F.concat(F.lit(f'{HEAD}<w:{tag} xmlns:w="urn:w" xmlns:r="urn:r" xmlns:m="urn:m">{before}'), inside, F.lit(f"</w:{tag}>"))
    parts = {
        "word/document.xml": whole("document", F.col("body")), "word/_rels/document.xml.rels": F.concat(F.lit(HEAD + '<Relationships xmlns="urn:p">'), F.col("targets"), F.lit("</Relationships>")),
        "word/footnotes.xml": whole("footnotes", F.col("notes"), '<w:footnote w:type="separator" w:id="-1"><w:p><w:r><w:t>-</w:t></w:r></w:p></w:footnote>'), "word/comments.xml": whole("comments", F.col("comments")),
        "word/header1.xml": whole("hdr", says(F.concat(F.lit("head "), "path"))), "word/footer1.xml": whole("ftr", F.lit("<w:p/>")),
    }
    return docs.select("path", _archive(parts).alias("content"))


def decks(orders: DataFrame) -> DataFrame:
    """path, content: an order a slide, forty a deck: a table of two rows and speaker's notes, which every fifth slide does not have."""
    k = F.col("o_orderkey")
    says = lambda *t: F.concat(*[x for part in t for x in (F.lit("<a:p><a:r><a:t>"), part, F.lit("</a:t></a:r></a:p>"))])
    cell = lambda t, more="": F.concat(F.lit(f"<a:tc{more}><a:txBody>"), t, F.lit("</a:txBody><a:tcPr/></a:tc>"))
    row = lambda *cells: F.concat(F.lit('<a:tr h="1">'), *cells, F.lit("</a:tr>"))
    table = F.concat(F.lit("<a:tbl><a:tblPr/>"), row(cell(says(F.concat(F.lit("c"), F.col("o_custkey"))), ' gridSpan="2"'), cell(F.lit("<a:p/>"), ' hMerge="1"')), row(cell(says(F.col("o_orderstatus"), F.lit("a&lt;b_x0041_"))), cell(says(F.col("o_orderpriority")))), F.lit("</a:tbl>"))
    slide = F.concat(F.lit(HEAD + '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:graphicFrame>'), table, F.lit("</p:graphicFrame></p:sld>"))
    target = F.when(k % 5 != 0, F.concat(F.lit('<Relationship Id="rId1" Type="n" Target="../notesSlides/notesSlide'), k % 40 + 1, F.lit('.xml"/>'))).otherwise(F.lit(""))
    related = F.concat(F.lit(HEAD + '<Relationships xmlns="urn:p"><Relationship Id="rId9" Type="l" Target="../slideLayouts/slideLayout1.xml"/>'), target, F.lit("</Relationships>"))
    shape = lambda kind, t: F.concat(F.lit(f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}" idx="1"/></p:nvPr></p:nvSpPr><p:txBody>'), t, F.lit("</p:txBody></p:sp>"))
    notes = F.concat(F.lit(HEAD + '<p:notes xmlns:p="urn:p" xmlns:a="urn:a">'), shape("sldNum", says((k % 40 + 1).cast("string"))), shape("body", says(F.concat(F.lit("say "), F.col("o_custkey")), F.lit(" "), F.col("o_orderstatus"))), F.lit("</p:notes>"))
    return _sheaf(orders, ".pptx", ("ppt/slides/slide#.xml", slide), ("ppt/slides/_rels/slide#.xml.rels", related), ("ppt/notesSlides/notesSlide#.xml", notes))


def nested_word_files(part: DataFrame) -> DataFrame:
    """path, content: a table a part, twenty a document, most with a table in their first cell and some with one in that; prefixes in turn.

    Paragraphs have tab stops, hyphens that don't break and breaks; the inner table has cells over columns and rows.
    """
    size = F.col("size")
    p = _dealt(part.select(F.floor(F.col("p_partkey") / 20).alias("doc"), (F.col("p_partkey") % 20).cast("int").alias("k"), "p_partkey", "p_name", F.col("p_size").cast("int").alias("size")), "doc")
    says = lambda *t: F.concat(F.lit('<w:p><w:pPr><w:tabs><w:tab w:val="left" w:pos="9"/></w:tabs></w:pPr><w:r><w:t>'), *t, F.lit("</w:t></w:r></w:p>"))
    cell = lambda inside, props="": F.concat(F.lit(f"<w:tc><w:tcPr>{props}</w:tcPr>"), inside, F.lit("</w:tc>"))
    table = lambda *rows: F.concat(F.lit("<w:tbl><w:tblPr/>"), *[x for r in rows for x in (F.lit('<w:tr w:rsidR="1">'), r, F.lit("</w:tr>"))], F.lit("</w:tbl>"))
    deep = F.when(size % 2 == 0, table(cell(says(F.lit("deep"), "p_partkey")))).otherwise(F.lit("<w:p/>"))
    inner = table(
        cell(says(F.lit("i</w:t><w:noBreakHyphen/><w:t>"), size), '<w:gridSpan w:val="2"/>'),
        F.concat(cell(says(F.lit("m"), size), '<w:vMerge w:val="restart"/>'), cell(says(F.lit("x</w:t><w:cr/><w:t>y")))),
        F.concat(cell(F.lit("<w:p/>"), "<w:vMerge/>"), cell(deep)),
    )
    p = p.withColumn("t", table(F.concat(cell(F.concat(says("p_name"), F.when(size % 3 != 0, inner).otherwise(F.lit("")))), cell(says(size.cast("string"))))))
    docs = _gathered(p, "doc", "k", body=F.col("t"))
    body = F.concat(F.lit(HEAD + '<w:document xmlns:w="urn:w"><w:body>'), "body", F.lit("</w:body></w:document>"))
    prefix = F.get(F.array(*map(F.lit, ("w:", "word:", ""))), (F.col("doc") % 3).cast("int"))
    return docs.select(F.concat(F.lit("/in/"), "doc", F.lit(".docx")).alias("path"), _archive({"word/document.xml": F.replace(body, F.lit("w:"), prefix)}).alias("content"))


def listed_decks(orders: DataFrame) -> DataFrame:
    """path, content: an order a slide, forty a deck, which lists them from the last order to the first; some are hidden.

    A slide has a shape, a group within a group that holds another, and a connector from the one into the other.
    """
    k, nth = F.col("o_orderkey"), (F.col("o_orderkey") % 40).cast("string")
    shape = lambda n, t: F.concat(F.lit(f'<p:sp useBgFill="1"><p:nvSpPr><p:cNvPr id="{n}" name="s"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>'), t, F.lit("</a:t></a:r></a:p></p:txBody></p:sp>"))
    group = lambda n, inside: F.concat(F.lit(f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="{n}" name="g"/></p:nvGrpSpPr>'), inside, F.lit("</p:grpSp>"))
    line = '<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="9" name="c"/><p:cNvCxnSpPr><a:stCxn id="2" idx="1"/><a:endCxn id="5" idx="0"/></p:cNvCxnSpPr></p:nvCxnSpPr><p:spPr><a:ln><a:headEnd type="none"/><a:tailEnd type="arrow"/></a:ln></p:spPr></p:cxnSp>'
    show = F.when(k % 7 == 0, F.lit(' show="false"')).when(k % 7 == 1, F.lit(' show="1"')).otherwise(F.lit(""))
    slide = F.concat(F.lit(HEAD + '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"'), show, F.lit(">"), shape(2, F.concat(F.lit("c"), "o_custkey")), group(3, group(4, shape(5, F.col("o_orderpriority")))), F.lit(line + "</p:sld>"))
    listed = F.concat(F.lit('<p:sldId id="'), k % 40 + 256, F.lit('" r:id="rId'), nth, F.lit('"/>'))
    related = F.concat(F.lit('<Relationship Id="rId'), nth, F.lit('" Type="t" Target="slides/slide'), nth, F.lit('.xml"/>'))
    one = F.struct((-k).alias("o"), F.concat(F.lit("ppt/slides/slide"), nth, F.lit(".xml")).alias("name"), slide.alias("text"), listed.alias("listed"), related.alias("related"))
    own = _dealt(orders.withColumn("path", F.concat(F.lit("/in/"), F.floor(k / 40).cast("string"), F.lit(".pptx"))), "path")
    decks = own.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("m"))
    joined = lambda field: F.array_join(F.transform("m", lambda x: x[field]), "")
    whole = F.concat(F.lit(HEAD + '<p:presentation xmlns:p="urn:p" xmlns:r="urn:r"><p:sldIdLst>'), joined("listed"), F.lit("</p:sldIdLst></p:presentation>"))
    rels = F.concat(F.lit(HEAD + '<Relationships xmlns="urn:q">'), joined("related"), F.lit("</Relationships>"))
    names = F.concat(F.array(F.lit("ppt/presentation.xml"), F.lit("ppt/_rels/presentation.xml.rels")), F.transform("m", lambda x: x["name"]))
    return decks.select("path", zipped(names, F.concat(F.array(whole, rels), F.transform("m", lambda x: x["text"]))).alias("content"))


def epubs(orders: DataFrame) -> DataFrame:
    """path, content: an order a chapter, forty a book, whose spine lists them from the last order to the first; the package lies in a folder."""
    k, nth = F.col("o_orderkey"), (F.col("o_orderkey") % 40).cast("string")
    html = F.concat(F.lit("<html><head><title/></head><body><h2>c"), "o_custkey", F.lit("</h2><p>"), "o_orderpriority", F.lit(" &amp; "), k, F.lit("</p><ul><li>i"), "o_orderstatus", F.lit("</li></ul></body></html>"))
    item = F.concat(F.lit('<item id="x'), nth, F.lit('" href="text/c%20'), nth, F.lit('.xhtml" media-type="application/xhtml+xml"/>'))
    one = F.struct((-k).alias("o"), F.concat(F.lit("OPS/text/c "), nth, F.lit(".xhtml")).alias("name"), html.alias("text"), item.alias("item"), F.concat(F.lit('<itemref idref="x'), nth, F.lit('"/>')).alias("ref"))
    own = _dealt(orders.withColumn("path", F.concat(F.lit("/in/"), F.floor(k / 40).cast("string"), F.lit(".epub"))), "path")
    found = own.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("m"))
    joined = lambda field: F.array_join(F.transform("m", lambda x: x[field]), "")
    package = F.concat(F.lit(HEAD + '<o:package xmlns:o="urn:o"><o:manifest>'), joined("item"), F.lit("</o:manifest><o:spine>"), joined("ref"), F.lit("</o:spine></o:package>"))
    container = F.lit(HEAD + '<container><rootfiles><rootfile full-path="OPS/book.opf" media-type="x"/><rootfile full-path="other.opf"/></rootfiles></container>')
    names = F.concat(F.array(F.lit("META-INF/container.xml"), F.lit("OPS/book.opf"), F.lit("other.opf")), F.transform("m", lambda x: x["name"]))
    return found.select("path", zipped(names, F.concat(F.array(container, F.regexp_replace(package, "<(/?)(item|itemref)\\b", "<$1o:$2"), F.lit("<package/>")), F.transform("m", lambda x: x["text"]))).alias("content"))


def csv_files(part: DataFrame) -> DataFrame:
    """path, content: thirty parts a file, with one of four separators, quoted cells over two lines, some with a mark of their encoding."""
    file, k = F.floor(F.col("p_partkey") / 30), F.col("p_partkey")
    sign = F.get(F.array(*map(F.lit, (",", ";", "\t", "|"))), (F.col("file") % 4).cast("int"))
    p = _dealt(part.select(file.alias("file"), k, "p_name", "p_size"), "file").withColumn("sign", sign)
    line = F.concat(F.col("p_partkey").cast("string"), "sign", F.lit('"a ""b""'), "sign", F.lit("\n"), "p_name", F.lit('"'), "sign", F.col("p_size").cast("string"), F.lit("\r\n"), F.when(F.col("p_size") % 9 == 0, "\r\n").otherwise(""))
    files = _gathered(p.withColumn("line", line), "file", "p_partkey", text=F.col("line"))
    mark = F.when(F.col("file") % 3 == 0, "﻿").otherwise("")
    return files.select(F.concat(F.lit("/in/"), "file", F.lit(".csv")).alias("path"), F.encode(F.concat(mark, "text"), "UTF-8").alias("content"))


def shared_books(part: DataFrame) -> DataFrame:
    """path, content: forty parts a workbook: a number, and a formula that the first row shares with the others (every third without cache); a merge and a declared table."""
    p = _dealt(part.select(F.floor(F.col("p_partkey") / 40).alias("book"), (F.col("p_partkey") % 40).cast("int").alias("k"), F.col("p_size").cast("int").alias("size")), "book")
    first = F.row_number().over(Window.partitionBy("book").orderBy("k")) == 1
    r = (F.col("k") + 1).cast("string")
    shared = F.when(first, F.concat(F.lit('<f t="shared" ref="B1:B40" si="0">A'), r, F.lit("*2+$A$1+SUM(A"), r, F.lit(":C"), (F.col("k") + 2).cast("string"), F.lit(")</f>"))).otherwise(F.lit('<f t="shared" si="0"/>'))
    cached = F.when(F.col("size") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<v>"), F.col("size") * 2, F.lit("</v>")))
    row = F.concat(F.lit('<x:row r="'), r, F.lit('"><x:c r="A'), r, F.lit('"><x:v>'), F.col("size"), F.lit('</x:v></x:c><x:c r="B'), r, F.lit('">'), F.regexp_replace(F.concat(shared, cached), "<(/?)([fv])\\b", "<$1x:$2"), F.lit("</x:c></x:row>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "")
    books = p.withColumn("row", row).groupBy("book").agg(joined.alias("rows"), F.count(F.lit(1)).alias("n"))
    sheet = F.concat(F.lit(HEAD + '<x:worksheet xmlns:x="urn:s" xmlns:y="urn:r"><x:sheetData>'), "rows", F.lit('</x:sheetData><x:mergeCells><x:mergeCell ref="A1:C1"/></x:mergeCells><x:tableParts><x:tablePart y:id="rId5"/></x:tableParts></x:worksheet>'))
    table = F.concat(F.lit(HEAD + '<table xmlns="urn:s" id="1" name="t" displayName="Tabla_'), "book", F.lit('" ref="A2:B'), F.col("n") + 2, F.lit('"/>'))
    fixed = F.lit(HEAD + '<workbook xmlns="urn:s" xmlns:r="urn:r"><sheets><sheet name="Main" sheetId="1" r:id="rId1"/></sheets></workbook>')
    rels = F.lit(HEAD + '<Relationships xmlns="urn:p"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
    own = F.lit(HEAD + '<Relationships xmlns="urn:p"><Relationship Id="rId5" Type="t" Target="../tables/table1.xml"/></Relationships>')
    parts = {"xl/workbook.xml": fixed, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/_rels/sheet1.xml.rels": own, "xl/tables/table1.xml": table}
    return books.select(F.concat(F.lit("/in/"), "book", F.lit(".xlsx")).alias("path"), _archive(parts).alias("content"))


def odd_archives(part: DataFrame) -> DataFrame:
    """path, content: an archive a part: whole, with a repeated name, cut short, of other bytes, empty or null in turn."""
    k = F.col("p_partkey") % 6
    name = F.when(k == 1, "a.xml").otherwise("b.xml")
    whole = zipped(F.array(F.lit("a.xml"), name), F.array(F.concat(F.lit("<a>"), "p_name", F.lit("</a>")), F.lit("<b/>")))
    content = F.when(k < 2, whole).when(k == 2, F.substring(whole, 1, 40)).when(k == 3, F.encode("p_name", "UTF-8")).when(k == 4, F.lit(b""))
    return part.select(F.concat(F.lit("/in/"), "p_partkey").alias("path"), content.alias("content"))
