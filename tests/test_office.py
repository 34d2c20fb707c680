"""Office archives: what the readers take from their XML, and what the guard refuses."""

import io
import zipfile

import pytest

from quire.plans import samples
from quire.sources import channels, office, ooxml

NS = 'xmlns="urn:s" xmlns:r="urn:r" xmlns:w="urn:w"'


def zipped(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def members(spark, *contents):
    rows = [(f"f{k}", c) for k, c in enumerate(contents)]
    return office.members(spark.createDataFrame(rows, "path string, content binary"), "\\.(xml|rels)$")


def workbook(**sheets) -> bytes:
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets))
    targets = "".join(f'<Relationship Id="r{k}" Target="worksheets/{n}.xml"/>' for k, n in enumerate(sheets))
    strings = '<si><t xml:space="preserve"> a &amp; b</t></si><si><r><t>one </t></r><r><t>two</t></r></si>'
    parts = {"xl/workbook.xml": f"<workbook {NS}><sheets>{names}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships>{targets}</Relationships>", "xl/sharedStrings.xml": f"<sst {NS}>{strings}</sst>"}
    return zipped(**parts, **{f"xl/worksheets/{n}.xml": f"<worksheet {NS}><sheetData>{x}</sheetData></worksheet>" for n, x in sheets.items()})


def test_workbook_cells_keep_blanks_falsehood_and_missing_caches(spark):
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="XFD1" t="s"><v>1</v></c><c r="C1"/></row><row r="5"><c r="F5"><v>0</v></c><c r="H5" t="b"><v>0</v></c><c r="C7"><f>F5+2</f><v>2</v></c><c r="C9"><f>F5</f></c></row>'
    found = members(spark, workbook(Main=rows, Empty=""))
    cells = {(r.sheet, r.cell): (r.value, r.formula, r.col) for r in office.workbook_cells(found).collect()}
    assert cells == {
        ("Main", "A1"): (" a & b", None, 1), ("Main", "XFD1"): ("one two", None, 16384), ("Main", "F5"): ("0", None, 6), ("Main", "H5"): ("FALSE", None, 8),
        ("Main", "C7"): ("2", "F5+2", 3), ("Main", "C9"): ("[SIN CACHÉ] F5", "F5", 3),
    }
    assert office.workbook_sheets(found).count() == 2 and office.workbook_merges(found).count() == 0


def paragraph(text, inside=""):
    return f"<w:p>{inside}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_word_tables_spans_merges_gaps_and_inner_tables(spark):
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{text}</w:tc>"
    rows = [
        cell(paragraph("a"), '<w:vMerge w:val="restart"/>') + cell(paragraph("b") + paragraph("c"), '<w:gridSpan w:val="2"/>'),
        cell(paragraph(""), "<w:vMerge/>") + cell(paragraph("d")) + cell(f"<w:tbl><w:tr>{cell(paragraph('in'))}</w:tr></w:tbl><w:p/>"),
        cell(paragraph("e")),
    ]
    table = "".join(f"<w:tr>{'<w:trPr><w:gridBefore w:val=\"1\"/></w:trPr>' if k == 2 else ''}{r}</w:tr>" for k, r in enumerate(rows))
    found = members(spark, zipped(**{"word/document.xml": f"<w:document {NS}><w:body>{paragraph('before')}<w:tbl>{table}</w:tbl>{paragraph('after')}</w:body></w:document>"}))
    grid = {(r.row_no, r.col): r.text for r in office.word_tables(found).collect()}
    assert grid == {(1, 1): "a", (1, 2): "b\nc", (1, 3): "b\nc", (2, 1): "a", (2, 2): "d", (2, 3): "[tabla anidada 1.1]", (3, 2): "e"}
    told = [(r.kind, r.text) for r in office.word_paragraphs(found).orderBy("nth").collect()]
    assert told == [("paragraph", "before"), ("cell", "a"), ("cell", "b"), ("cell", "c"), ("cell", "d"), ("cell", "in"), ("cell", "e"), ("paragraph", "after")]


def test_the_guard_tells_why_an_archive_stays_closed(spark):
    found = members(spark, b"PK..", None, b"", workbook(Main=""))
    assert [(r.path, r.fault) for r in found.filter("fault IS NOT NULL").orderBy("path").collect()] == [("f0", "damaged"), ("f1", "damaged"), ("f2", "damaged")]
    assert found.filter("path = 'f3'").count() == 4


@pytest.mark.parametrize(
    ("names", "sizes", "encrypted", "size", "want"),
    [(["a"], [1], False, 9, None), (["a", "a"], [1, 1], False, 9, "repeated names"), (["a"], [1], True, 9, "encrypted"), (["a"], [60_000_000], False, 9, "too large"), ([str(k) for k in range(20_001)], [0] * 20_001, False, 9, "too many entries"), ([], [], False, 100_000_001, "too large")],
)
def test_archive_limits(names, sizes, encrypted, size, want):
    assert office.archive_fault(names, sizes, encrypted, size) == want


def test_no_archives_give_no_rows(spark):
    none = office.members(spark.createDataFrame([], "path string, content binary"))
    assert [f(none).count() for f in (office.workbook_cells, office.word_tables, office.word_paragraphs, office.slide_shapes, office.drawing_edges)] == [0] * 5


def test_word_channels_skip_separators_and_blanks_and_keep_lines(spark):
    notes = f'<w:footnotes {NS}><w:footnote w:type="separator" w:id="-1"><w:p><w:r><w:t>-</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p><w:r><w:footnoteRef/><w:t xml:space="preserve">a </w:t></w:r><w:r><w:tab/><w:t>b</w:t></w:r></w:p> <w:p w:x="1"><w:r><w:t>c</w:t></w:r></w:p></w:footnote><w:footnote w:id="3"><w:p/></w:footnote></w:footnotes>'
    found = members(spark, zipped(**{"word/footnotes.xml": notes, "word/endnotes.xml": f"<w:endnotes {NS}/>", "word/footer2.xml": f"<w:ftr {NS}><w:p><w:r><w:t>end</w:t></w:r></w:p></w:ftr>", "word/settings.xml": "<x/>"}), None)
    rows = {tuple(r) for r in channels.word_channels(found).drop("member", "path").collect()}
    assert rows == {("footnote", 2, 2, None, "a \tb\nc"), ("footer", 1, None, None, "end")}


def test_links_without_relation_and_with_anchor(spark):
    link = lambda inside, text: f"<w:hyperlink {inside}><w:r><w:t>{text}</w:t></w:r></w:hyperlink>"
    body = f'<w:document {NS}><w:p>{link("r:id=\"r1\"", "one")}{link("r:id=\"r1\" w:anchor=\"top\"", "two")}{link("r:id=\"r9\"", "lost")}{link("w:anchor=\"x\"", "in")}</w:p></w:document>'
    found = members(spark, zipped(**{"word/document.xml": body, "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="https://e/"/></Relationships>'}))
    assert {(r.text, r.target) for r in channels.word_links(found).collect()} == {("one", "https://e/"), ("two", "https://e/#top"), ("lost", None), ("in", "#x")}


@pytest.mark.parametrize(
    "xml,want",
    [
        ("<m:oMath><m:sSubSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sub><m:r><m:t>i</m:t></m:r></m:sub><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSubSup></m:oMath>", "x_(i)^(2)"),
        ('<m:oMath><m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub><m:r><m:t>i</m:t></m:r></m:sub><m:sup/><m:e><m:r><m:t>i</m:t></m:r></m:e></m:nary></m:oMath>', "∑_(i)^() i"),
        ("<m:oMath><m:rad><m:deg><m:r><m:t>3</m:t></m:r></m:deg><m:e><m:r><w:rPr/><m:t>{y}</m:t></m:r></m:e></m:rad></m:oMath>", "root[3]({y})"),
        ("<m:oMath><m:d><m:e><m:r><m:t>a</m:t></m:r></m:e><m:e><m:r><m:t>b</m:t></m:r></m:e></m:d></m:oMath>", "(a,b)"),
        ("<m:oMath><m:f></m:oMath>", None),
        ("<m:oMath/>", ""),
        ("<m:oMath><m:r><m:t>see a:b</m:t></m:r></m:oMath>", "see a:b"),
        ("<oMath><r><t>bare</t></r></oMath>", "bare"),
    ],
)
def test_formulas_on_one_line(xml, want):
    rows = ooxml.WordPart().read(f"<w:document><w:p>{xml}</w:p></w:document>".encode())
    assert [r["text"] for r in rows if r["kind"] == "formula"] == ([want] if want is not None else [])
    assert want is not None or rows == [{"kind": "damaged"}]


def test_runs_keep_hyphens_breaks_and_symbols_and_no_tab_stops():
    body = """<x:document xmlns:x="urn:any" xmlns:y="urn:mc"><x:p><x:pPr><x:tabs><x:tab x:val="left"/><x:tab x:val="left"/></x:tabs></x:pPr>
      <x:r><x:t>A</x:t><x:noBreakHyphen/><x:t>B</x:t><x:cr/><x:t>C</x:t><x:tab/><x:sym x:font="Wingdings" x:char="F041"/><x:sym x:char="zz"/></x:r>
      <x:del><x:r><x:delText>gone</x:delText></x:r></x:del><y:AlternateContent><y:Choice><x:r><x:t>one</x:t></x:r></y:Choice><y:Fallback><x:r><x:t>one</x:t></x:r></y:Fallback></y:AlternateContent></x:p></x:document>"""
    assert [r["text"] for r in ooxml.WordPart().read(body.encode())] == ["A-B\nC\tAone"]


def test_parts_that_are_damaged_or_declare_entities_are_told(spark):
    assert ooxml.WordPart().read(b"<a><b></a>") == ooxml.SlidePart().read(b'<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>') == [{"kind": "damaged"}]
    found = members(spark, zipped(**{"word/document.xml": "<w:p"}))
    assert office.word_paragraphs(found).count() == office.word_grids(found).count() == 0


def test_tables_within_tables_are_tables_of_their_own(spark):
    cell = lambda inside, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{inside}</w:tc>"
    table = lambda *rows: "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    deep = table(cell(paragraph("deep")))
    inner = table(cell(paragraph("i"), '<w:gridSpan w:val="2"/>') + cell(deep + "<w:p/>"), cell(paragraph("j"), '<w:vMerge w:val="restart"/>'), cell(paragraph("lost"), "<w:vMerge/>"))
    found = members(spark, zipped(**{"word/document.xml": f"<w:document {NS}>{table(cell(paragraph('a') + inner + paragraph('b') + table(cell(paragraph('second')))))}{table(cell(paragraph('next')))}</w:document>"}))
    grid = {(r.label, r.row_no, r.col): (r.parent, r.text) for r in office.word_grids(found).collect()}
    assert grid == {
        ("1", 1, 1): (None, "a\n[tabla anidada 1.1]\nb\n[tabla anidada 1.2]"), ("1.1", 1, 1): ("1", "i"), ("1.1", 1, 2): ("1", "i"), ("1.1", 1, 3): ("1", "[tabla anidada 1.1.1]"),
        ("1.1", 2, 1): ("1", "j"), ("1.1", 3, 1): ("1", "j"), ("1.1.1", 1, 1): ("1.1", "deep"), ("1.2", 1, 1): ("1", "second"), ("2", 1, 1): (None, "next"),
    }
    assert [r.text for r in office.word_tables(found).filter("table_no = 2").collect()] == ["next"]


def test_slides_are_as_the_presentation_lists_them_and_groups_are_walked(spark):
    shape = lambda n, text, more="": f'<q:sp {more}><q:nvSpPr><q:cNvPr id="{n}"/></q:nvSpPr><q:txBody><d:p><d:r><d:t>{text}</d:t></d:r></d:p></q:txBody></q:sp>'
    line = '<q:cxnSp><q:nvCxnSpPr><q:cNvPr id="9"/><q:cNvCxnSpPr><d:stCxn id="2" idx="0"/><d:endCxn id="5" idx="0"/></q:cNvCxnSpPr></q:nvCxnSpPr><d:ln><d:tailEnd type="arrow"/></d:ln></q:cxnSp>'
    group = f'<q:grpSp><q:nvGrpSpPr><q:cNvPr id="3"/></q:nvGrpSpPr><q:grpSp><q:nvGrpSpPr><q:cNvPr id="4"/></q:nvGrpSpPr>{shape(5, "in")}</q:grpSp></q:grpSp>'
    deck = zipped(**{
        "ppt/presentation.xml": '<q:presentation xmlns:q="u" xmlns:s="v"><q:sldIdLst><q:sldId id="256" s:id="r2"/><q:sldId s:id="r1" id="257"/></q:sldIdLst></q:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="/ppt/slides/slide7.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f'<q:sld show="false">{shape(2, "last", "useBgFill=\'1\'")}</q:sld>', "ppt/slides/slide7.xml": f"<q:sld>{shape(2, 'first')}{group}{line}</q:sld>",
        "ppt/slides/_rels/slide7.xml.rels": '<Relationships><Relationship Id="r1" Target="../notesSlides/notesSlide4.xml"/></Relationships>',
        "ppt/notesSlides/notesSlide4.xml": '<q:notes><q:sp><q:nvPr><q:ph type="body"/></q:nvPr><q:txBody><d:p><d:r><d:t>say</d:t></d:r></d:p></q:txBody></q:sp></q:notes>',
    })
    found = members(spark, deck)
    assert [(r.slide, r.shape_id, r.groups, r.text, r.hidden) for r in office.slide_shapes(found).orderBy("slide", "nth").collect()] == [(1, 2, [], "first", False), (1, 5, [3, 4], "in", False), (2, 2, [], "last", True)]
    assert [tuple(r)[1:] for r in office.slide_connectors(found).collect()] == [(1, 9, 2, 5, None, "arrow")]
    assert [(r.slide, r.text) for r in channels.slide_notes(found).collect()] == [(1, "say")]


def test_slides_without_tables_or_notes_give_no_rows(spark):
    found = members(spark, zipped(**{"ppt/slides/slide1.xml": "<p:sld/>", "ppt/slides/_rels/slide1.xml.rels": "<Relationships/>", "ppt/notesSlides/notesSlide1.xml": "<p:notes/>"}), b"no archive")
    assert channels.slide_tables(found).count() == channels.slide_notes(found).count() == 0


def test_shared_formulas_are_moved_to_their_cells_and_both_layers_meet(spark):
    rows = """<row r="1"><c r="A1"><v>5</v></c><c r="B1"><f t="shared" ref="B1:C2" si="0">A1*$A$1+A$1&amp;"A1"+SUM(A1:A2)</f><v>10</v></c><c r="C1"><f t="shared" si="0"/><v>1</v></c></row>
      <row r="2"><c r="B2"><f t="shared" si="0"/></c><c r="D2" t="str"><f>T(1)</f><v>_x0041_</v></c><c r="E2" t="e"><v>#N/A</v></c></row>"""
    found = members(spark, workbook(Main=rows))
    cells = {r.cell: (r.value, r.formula) for r in office.workbook_cells(found).collect()}
    assert cells == {
        "A1": ("5", None), "B1": ("10", 'A1*$A$1+A$1&"A1"+SUM(A1:A2)'), "C1": ("1", 'B1*$A$1+B$1&"A1"+SUM(B1:B2)'), "B2": ('[SIN CACHÉ] A2*$A$1+A$1&"A1"+SUM(A2:A3)', 'A2*$A$1+A$1&"A1"+SUM(A2:A3)'), "D2": ("A", "T(1)"), "E2": ("#N/A", None),
    }
    formulas, values = office.workbook_layers(found)
    assert formulas.count() == 4 and values.count() == 5


def test_sheets_over_the_limit_are_told(spark, monkeypatch):
    class Small(ooxml.SheetPart):
        MOST_CELLS = 2

    assert Small().read(b'<s><c r="A1"/><mergeCell ref="A1:B1"/><c r="A2"/></s>') == [{"kind": "cell", "cell": "A1", "type": "n"}, {"kind": "merge", "ref": "A1:B1"}, {"kind": "cell", "cell": "A2", "type": "n"}]
    assert Small().read(b'<s><c r="A1"/><c r="A2"/><c r="A3"/><mergeCell ref="A1:B1"/></s>') == [{"kind": "too large", "value": "3"}]
    found = members(spark, workbook(Main="<row><c r='A1'></row>", Fine=""))
    assert [tuple(r) for r in office.workbook_refusals(found).collect()] == [("f0", "Main", None, "damaged")]


def test_declared_tables_and_merges(spark):
    sheet = '<x:worksheet xmlns:x="u" xmlns:q="r"><x:sheetData/><x:mergeCells><x:mergeCell ref="B2:C3"/></x:mergeCells><x:tableParts><x:tablePart q:id="r1"/></x:tableParts></x:worksheet>'
    book = zipped(**{
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="S" sheetId="1" r:id="r0"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r0" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": sheet,
        "xl/worksheets/_rels/s.xml.rels": '<Relationships><Relationship Id="r1" Target="../tables/table1.xml"/></Relationships>', "xl/tables/table1.xml": '<table name="t" displayName="Tabla_1" ref="B5:AA9"/>',
    })
    found = members(spark, book)
    assert [tuple(r) for r in office.workbook_tables(found).select("path", "sheet", "name", "min_row", "min_col", "max_row", "max_col").collect()] == [("f0", "S", "Tabla_1", 5, 2, 9, 27)]
    assert [tuple(r) for r in office.workbook_merges(found).select("sheet", "min_row", "min_col", "max_row", "max_col").collect()] == [("S", 2, 2, 3, 3)]


def test_archives_do_not_travel_in_batches_of_thousands(spark):
    """Arrow's batches are counted in rows: ten thousand archives, or their texts, would be held at once."""
    orders = spark.createDataFrame([(k, 1, "O", "1-URGENT") for k in range(90)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    archives = samples.presentations(orders)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (archives, office.members(archives))]
    assert not [name for name in ("ArrowEvalPython", "MapInPandas", "MapInArrow") for plan in plans if name in plan]
    found = office.members(archives, "slide1\\.xml$").collect()
    assert sorted((r.path, r.member, r.fault) for r in found) == [(f"/in/{k}.pptx", "ppt/slides/slide1.xml", None) for k in range(3)]


def test_parts_are_not_read_in_arrow_batches_and_slides_once(spark, monkeypatch):
    """Arrow's batches hold ten thousand members or 64 MB, whatever a worker's memory; both readers of a diagram share one pass."""
    orders = spark.createDataFrame([(k, 1, "O", "1-URGENT") for k in range(90)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    found = office.unpacked(samples.listed_decks(orders), "^ppt/")
    read = []
    monkeypatch.setattr(office, "rows_of", lambda f, member, reader: read.append(reader) or ooxml.rows_of(f, member, reader))
    connectors, shapes = office.slide_diagrams(found)
    assert read.count(ooxml.SlidePart) == 1 and connectors.count() == 90 and shapes.count() == 180
    rows = ooxml.rows_of(found, "^ppt/slides/", ooxml.SlidePart)
    assert not [n for n in ("MapInArrow", "ArrowEvalPython") if n in rows._jdf.queryExecution().executedPlan().toString()]


def test_texts_of_archives_are_made_after_their_rows_are_dealt(spark, monkeypatch):
    """Texts made before the shuffle were one task's, as a table in one small file is, and moved whole."""
    monkeypatch.setattr(samples, "TEXT_ROWS", 20)
    orders = spark.createDataFrame([(k, k % 7, "O", "1-URGENT") for k in range(90)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    for made in (samples.listed_decks, samples.presentations, samples.decks, samples.epubs):
        plan = made(orders)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_cells_of_word_tables_are_dealt_by_their_number(spark, monkeypatch):
    """Cells are parsed and written once, which counts them; merged by compressed bytes, a task sorted ever more of them."""
    monkeypatch.setattr(office, "dealt", lambda df, *key: df.repartition(3, *key))
    cell = f"<w:tc>{paragraph('a')}</w:tc>"
    found = members(spark, zipped(**{"word/document.xml": f"<w:document {NS}><w:tbl><w:tr>{cell}</w:tr></w:tbl></w:document>"}))
    grids = office.word_grids(found)
    plan = grids._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "FileScan" in plan and grids.count() == 1


def test_notes_chapters_and_edges_are_dealt_by_number_and_slides_read_once(spark, monkeypatch):
    """Merged by compressed bytes, a task joined ever more narrow rows; edges read every slide for shapes and again for connectors."""
    from quire.plans import registry
    from quire.sources import books

    monkeypatch.setattr(office, "TASK_MEMBERS", 20)
    orders = spark.createDataFrame([(k, k % 7, "O", "1-URGENT") for k in range(90)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    notes = channels.slide_notes(office.unpacked(samples.decks(orders), "^ppt/"))
    blocks = books.book_blocks(office.unpacked(samples.epubs(orders), "\\.(xml|opf|xhtml)$"))
    for told, rows in ((notes, 72), (blocks, 270)):
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") >= 2 and "BroadcastHashJoin" not in plan and told.count() == rows
    read = []
    monkeypatch.setattr(office, "rows_of", lambda f, member, reader: read.append(reader) or ooxml.rows_of(f, member, reader))
    monkeypatch.setattr(registry, "_t", lambda *_: orders)
    registry.QUERIES["slide_edges"](spark, "")
    assert read.count(ooxml.SlidePart) == 1


def test_slide_readers_hold_only_the_rows_that_are_asked_for(spark, monkeypatch):
    """Rows are held to the end of their part: a slide's cells and connectors were held and handed on for its shapes."""
    slide = b"<sld><sp><cNvPr id='2'/><txBody><p><r><t>a</t></r></p></txBody></sp><cxnSp><cNvPr id='3'/></cxnSp><graphicFrame><tbl><tr><tc><txBody><p/></txBody></tc></tr></tbl></graphicFrame></sld>"
    found = members(spark, zipped(**{"ppt/slides/slide1.xml": slide}))
    read = []
    monkeypatch.setattr(office, "rows_of", lambda f, member, reader: read.append(reader) or ooxml.rows_of(f, member, reader))
    for told, kind in ((office.slide_shapes, "shape"), (office.slide_connectors, "connector"), (channels.slide_tables, "cell")):
        rows = told(found)
        [reader] = [r for r in read if issubclass(r, ooxml.SlidePart)]
        assert [r["kind"] for r in reader().read(slide)] == [kind] and rows.count() == 1
        assert reader().read(b"<sld><sp/>") == [{"kind": "damaged"}]
        read.clear()
    assert len(ooxml.SlidePart().read(slide)) == 3


def test_word_readers_hold_only_the_rows_that_are_asked_for(spark, monkeypatch):
    """A body's paragraphs, cells and links were held and handed on for its formulas, its paragraphs' texts twice."""
    body = b"<document><p><r><t>a</t></r><hyperlink><r><t>b</t></r></hyperlink><oMath><r><t>x</t></r></oMath></p><tbl><tr><tc><p><r><t>c</t></r></p></tc></tr></tbl></document>"
    found = members(spark, zipped(**{"word/document.xml": body}))
    read = []
    for module in (channels, office):
        monkeypatch.setattr(module, "rows_of", lambda f, member, reader: read.append(reader) or ooxml.rows_of(f, member, reader))
    for told, kinds in ((channels.word_formulas, ["formula"]), (channels.word_links, ["link"]), (office.word_paragraphs, ["paragraph"] * 2), (office.word_grids, ["cell"])):
        rows, part = told(found), read.pop()()
        assert [r["kind"] for r in part.read(body)] == kinds and part.told == [] and rows.count() == len(kinds)
    notes = b"<footnotes><p><r><t>no</t></r></p><footnote id='1'><p><r><t>a</t></r></p><p><r><t>b</t></r></p></footnote></footnotes>"
    assert [(r.id, r.text) for r in channels.word_channels(members(spark, zipped(**{"word/footnotes.xml": notes}))).collect()] == [(1, "a\nb")]
    assert [r["kind"] for r in read.pop()().read(notes)] == ["footnote"]
