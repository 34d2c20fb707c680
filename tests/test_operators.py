"""Literal cases of the document operators, beside the comparison of every query with its SQL."""

import datetime
import io
import math
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import contracts as C
from quire.operators import documents as D
from quire.operators import library as L
from quire.operators import ranges
from quire.operators import retrieval as R
from quire.operators import sheets as S
from quire.plans import registry
from quire.sources import answers, files, pages
from quire.streaming import resumable


def one(spark, function, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return row.select(function(*(F.col(f"c{k}") for k in range(len(values)))).alias("v")).first().v


@pytest.mark.parametrize(
    ("given", "want"),
    [("# no", "\\# no"), ("> no", "\\> no"), ("---", "\\---"), ("1. no", "1\\. no"), ("- no", "\\- no"), ("text # as it is", "text # as it is"), ("<script>", "&lt;script>"), ("a\r\n| b", "a\n\\| b"),
     ("   12) x", "   12\\) x"), ("1234567890. x", "1234567890. x"), ("1.x", "1.x"), ("7.", "7\\."), ("    # code", "    # code"), ("===", "\\==="), ("== =", "== ="), ("* * *", "\\* * *"), ("-_*", "\\-_*"), ("**bold**", "**bold**"), ("+", "\\+"), ("~~~", "\\~~~"), ("``x", "``x"), ("", ""),
     ("&amp; &x", "&amp;amp; &x"), ("a\x00\x07b\x0bc", "ab\nc")],
)
def test_markdown_text(spark, given, want):
    assert one(spark, T.md_text, given) == want


def test_markdown_cells_and_names(spark):
    assert one(spark, T.md_cell, "a|b\r\nc\\d<e>&\x07") == "a&#124;b<br>c\\\\d&lt;e&gt;&amp;"
    assert one(spark, T.slug, "Ñandú & Co.") == "nandu-co" and one(spark, T.slug, "--") == "s"
    assert one(spark, T.safe_filename, ' a<b>:"c" . ') == "a b c" and one(spark, T.safe_filename, "con.txt") == "documento" and one(spark, T.safe_filename, "...") == "documento"
    assert [one(spark, T.column_letter, str(n)) for n in (1, 26, 27, 52, 702, 703, 18278)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]
    assert one(spark, T.cad_text, "{\\fRoman|b1;\\W.8;1} %%c20%%D\\Pend") == "1 Ø20° end"
    assert [one(spark, T.helper_header, h) for h in ("S1", "x", "Columna3", "Code", None)] == [True, True, True, False, False]
    assert one(spark, lambda c: T.pipe_columns(c), "| a \\| b | c |") == 2


@pytest.mark.parametrize(
    ("head", "tail", "want"),
    [("none", "none", "a — b"), ("triangle", "none", "b → a"), ("none", "arrow", "a → b"), ("stealth", "arrow", "a ↔ b"), (None, "arrow", "a — b"), ("diamond", "none", "a — b")],
)
def test_connectors(spark, head, tail, want):
    assert one(spark, T.connector, head, tail, "a", "b") == want


@pytest.mark.parametrize(
    ("scope", "want"),
    [("10,2,3-5", [2, 3, 4, 5, 10]), ("", None), ("0", None), ("-1", None), ("3-1", None), ("1,1", None), ("1-3,2", None), ("1-100001", None), ("abc", None), (" 7 ", [7]), ("99999999999", None)],
)
def test_scopes(spark, scope, want):
    assert one(spark, D.parse_scope, scope) == want


def blocks(spark, text):
    rows = D.parse_blocks(spark.createDataFrame([(1, 3, text)], "doc_id int, unit int, text string")).orderBy("block_no").collect()
    assert "".join(r.text for r in rows) == text
    return [(r.block_id, r.kind, r.level, r.text) for r in rows]


def test_blocks_keep_every_character(spark):
    found = blocks(spark, "# One\n\ntext\nmore\r\n\r\n```\n# code\n\n| x |\n````\n> quote\n## Two\n| a |\n1. list")
    assert [(k, t) for _, k, _, t in found] == [
        ("heading", "# One\n"), ("paragraph", "\n"), ("paragraph", "text\nmore\r\n\r\n"), ("code", "```\n# code\n\n| x |\n````\n> quote\n"), ("heading", "## Two\n"), ("table", "| a |\n1. list"),
    ]
    assert [i for i, *_ in found] == [f"p3-b{k}" for k in range(1, 7)] and found[4][2] == 2
    assert [k for _, k, _, _ in blocks(spark, "~~~~\n~~~\nopen")] == ["code"] and blocks(spark, "") == []


def test_coverage_and_rendering(spark):
    expected = spark.createDataFrame([(1, [2, 10, 3]), (2, [1]), (3, [])], "doc_id int, expected array<int>")
    received = spark.createDataFrame([(1, 10), (1, 2), (1, 2), (1, 7)], "doc_id int, unit int")
    found = {r.doc_id: r for r in D.coverage(expected, received).collect()}
    assert found[1].missing == [3] and found[1].errors == 3 and found[2].missing == [1] and found[3].status == "parcial"
    units = spark.createDataFrame([(1, 10, "ten"), (1, 2, "two")], "doc_id int, unit int, text string")
    text = {r.doc_id: r.markdown for r in D.render_units(expected, units).collect()}[1]
    assert text.index("two") < text.index("ten") < text.index("PENDIENTE")


def test_unit_flags(spark):
    rows = [(1, 1, "## Testigo (pág. 1)\n[Verificar] x"), (1, 2, " \n"), (1, 3, "![a](b) <SCRIPT>"), (1, 4, "fine javascript:")]
    found = [tuple(r)[2:] for r in D.unit_flags(spark.createDataFrame(rows, "doc_id int, unit int, text string"), paged=True).orderBy("unit").collect()]
    assert found == [(False, True, False, False, False), (True, False, False, False, True), (False, False, True, True, True), (False, False, False, True, True)]


def test_consult_keeps_to_its_budget_and_order(spark):
    long = "x" * 500 + " witness " + "y" * 3000
    rows = [("b", 1, 1, "p1-b10", "witness"), ("b", 1, 2, "p1-b2", "witness"), ("a", 2, 1, "p2-b1", long), ("c", 1, 1, "p1-b1", "no"), ("d", 1, 1, "p1-b1", "Witness WITNESS")]
    table = spark.createDataFrame(rows, "doc_id string, unit int, block_no int, block_id string, text string")
    hits = R.consult(table, "witness", 3, 1500).orderBy("rank").collect()
    assert [(h.doc_id, h.block_id, h.excerpt_truncated) for h in hits] == [("d", "p1-b1", False), ("a", "p2-b1", True), ("b", "p1-b10", False)]
    assert len(hits[1].excerpt) == 1400 and "witness" in hits[1].excerpt and sum(len(h.excerpt) for h in hits) <= 1500
    for wrong in (("...", 5, 4000), ("x", 0, 4000), ("x", 21, 4000), ("x", 5, 199)):
        with pytest.raises(ValueError, match="query|limit|max_chars"):
            R.consult(table, *wrong)
    assert [r.units for r in R.search_units(table, "WITNESS").orderBy("doc_id").collect()] == [[2], [1], [1]]


def test_routes_only_count_what_can_be_converted(spark):
    rows = [(0, "txt", "h"), (1, "txt", "h"), (2, "pdf", "p"), (3, "pdf", "p"), (4, "md", None), (5, "docx", "h")]
    found = {r.number: (r.route, r.duplicate_of) for r in L.plan_routes(spark.createDataFrame(rows, "number int, format string, sha256 string")).collect()}
    assert found == {0: ("local", None), 1: ("duplicado", 0), 2: ("pendiente", None), 3: ("pendiente", None), 4: ("pendiente", None), 5: ("duplicado", 0)}


def test_budgets_may_overshoot_once_and_stop_at_the_unknown(spark):
    rows = [(1, k, 1, t) for k, t in enumerate((10, 200, 5))] + [(2, 0, 1, None), (2, 1, 1, 1), (3, 0, 0, 9), (3, 1, 1, 1), (3, 2, 1, 1)]
    items = spark.createDataFrame(rows, "batch int, position int, calls int, tokens long")
    found = {r.batch: (r.started, r.calls, r.tokens, r.unknown) for r in L.budget_summary(L.run_budget(items, 2, 100)).collect()}
    assert found == {1: (2, 2, 210, 0), 2: (1, 1, 0, 1), 3: (3, 2, 2, 0)}


def test_failures_open_again(spark):
    t = lambda k: datetime.datetime(2024, 1, k)
    events = spark.createDataFrame([(t(1), "op", "E", "Lost  it"), (t(3), "op", "E", "lost it "), (t(2), "op", "E", "other")], "ts timestamp, operation string, error_type string, message string")
    base = {r.message: r for r in L.group_failures(events).collect()}
    assert base["lost it "].occurrences == 2 and base["other"].occurrences == 1
    solved = spark.createDataFrame([(base["lost it "].signature, t(2)), (base["other"].signature, t(4))], "signature string, resolved_at timestamp")
    assert {r.message: r.status for r in L.group_failures(events, solved).collect()} == {"lost it ": "abierto", "other": "resuelto"}


def test_integrity_names_and_queue(spark):
    files_ = [(1, n, "h", "h") for n in L.REQUIRED] + [(2, n, "h", "x" if n == "document.json" else "h") for n in L.REQUIRED[:2]]
    found = {r.doc_id: (r.integrity_ok, r.damaged) for r in L.integrity(spark.createDataFrame(files_, "doc_id int, name string, sha256 string, actual_sha256 string")).collect()}
    assert found == {1: (True, []), 2: (False, ["document.json", "verificacion.json"])}
    names = L.export_names(spark.createDataFrame([(1, "A"), (2, "a"), (3, "A (2)"), (4, "b/c")], "doc_id int, title string"))
    assert [r.name for r in names.orderBy("doc_id").collect()] == ["A", "a #2", "A (2)", "b c"]
    queue = spark.createDataFrame([("p", "1", "terminado"), ("q", "1", "terminado"), ("gone", "1", "listo")], "path string, sha256 string, status string")
    seen = spark.createDataFrame([("p", "1", "md"), ("q", "2", "pdf"), ("new", "3", "xyz")], "path string, sha256 string, format string")
    assert {r.path: (r.status, r.source_changed) for r in L.upsert_queue(queue, seen).collect()} == {"p": ("terminado", False), "q": ("requiere_paginas", True), "gone": ("listo", False), "new": ("pendiente", False)}


def test_regions_and_tables(spark):
    cells = [(1, r, c, v) for r, c, v in ((1, 1, "a"), (1, 2, "b"), (2, 2, "c"), (4, 1, "d"), (5, 1, "e"), (9, 9, "f"), (9, 8, " "))]
    found = S.regions(spark.createDataFrame(cells, "sheet long, row long, col long, value string")).orderBy("first_row").collect()
    assert [(r.source_ref, r.kind) for r in found] == [("A1:B2", "table"), ("A4:A5", "list"), ("I9:I9", "note")]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(["| a | b |", "|---|:-:|", "| 1 | 2", "| 1 |", "prose", "| lone |"])], "doc_id int, line_no int, line string")
    assert sorted((r.line_no, r.rule) for r in S.table_findings(lines, T.pipe_columns(F.trim("line"))).collect()) == [(2, "A1"), (2, "A2"), (3, "A2"), (5, "A4")]


def test_markers_are_whole(spark, tmp_path):
    """All of the marker counts, not its first five words; line ends, entities and escapes do not part it; short ones are found."""
    items = [(1, "a b c d e and its own end"), (2, "a b c d e as written"), (3, "two words"), (4, "one"), (5, "u v w"), (6, "nowhere"), (7, "x é & y_z <q> end"), (8, None)]
    texts = [("a b c d e as\nwritten, two<br/>words",), ("phone u v ware",), ("x &eacute; &amp;amp; y\\_z\t&#60;q&gt;  end",), (None,), ("a b c d e",)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.item_id for r in registry.marker_antijoin(spark, str(tmp_path)).collect()) == [1, 6, 8]
    markers, docs = (spark.createDataFrame(x, t).withColumn(c, T.readable(F.col("text"))) for x, t, c in ((items, "item_id long, text string", "marker"), (texts, "text string", "text")))
    assert sorted(r.item_id for r in D.absent_markers(markers, docs, 0).collect()) == [1, 6, 8]


def test_sniffing(spark):
    def archive(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return out.getvalue()

    rows = [
        ("a.docx", archive("word/document.xml"), "docx"), ("b", archive("xl/workbook.xml"), "xlsx"), ("c", archive("xl/workbook.bin"), "xlsb"), ("d", archive("word/a", "xl/b"), "zip-ambiguous"), ("e", archive("other"), "zip"), ("f", b"PK\x03\x04", "zip-damaged"),
        ("g.md", b"a" * 1023 + "ñ".encode(), "md"), ("h.xyz", b"text", "text"), ("i.txt", b"a\x00b", "unsupported"), ("j", b"\xff\xfe\x00", "unsupported"), ("k", b"", "empty"), ("l", b"999\nc\n0\nSECTION\n", "dxf"), ("l2", b"\n 999 \r\n\r\n999\nx\n  0\n\nSECTION", "dxf"), ("l3", b"0\nSECTIONS\n", "text"), ("l4", b"999\n0\nSECTION\n", "text"), ("l5", b"0\n", "text"), ("m.json", b"%PDF-1", "pdf"), ("n.html", "﻿é".encode(), "html"),
    ]
    found = {r.path: r.kind for r in files.sniffed(spark.createDataFrame([(p, bytearray(c)) for p, c, _ in rows], "path string, content binary")).collect()}
    assert found == {p: k for p, _, k in rows}


def test_inventory_skips_and_limits(spark, tmp_path):
    for name in ("a.txt", "b/c.txt", ".git/x", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = [r.path.rsplit("/", 1)[1] for r in files.inventory(spark, str(tmp_path), 2).collect()]
    assert found == ["a.txt", "c.txt"]


def test_html_blocks(spark):
    html = "<html><head><title>T &amp; t</title><script>no()</script></head><body><h2 class='x'>Head</h2><p>One <b>bold</b><br>two &lt;3<ul><li>item</ul><!-- gone --></body></html>"
    found = pages.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("block_no").collect()
    assert [(r.kind, r.level, r.text) for r in found] == [("paragraph", None, "T & t"), ("heading", 2, "Head"), ("paragraph", None, "One bold"), ("paragraph", None, "two <3"), ("list", None, "item")]


def test_stream_takes_each_item_once(spark, tmp_path):
    base = f"{tmp_path}/{uuid.uuid4().hex}"
    one = spark.createDataFrame([(k, "a") for k in range(10)], "id long, v string")
    one.repartition(4).write.parquet(f"{base}/in")
    assert resumable.ingest(spark, f"{base}/in", one.schema, f"{base}/state", ["id"], 1).count() == 10
    assert resumable.ingest(spark, f"{base}/in", one.schema, f"{base}/state", ["id"], 1).count() == 10
    one.union(spark.createDataFrame([(99, "b")], one.schema)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert resumable.ingest(spark, f"{base}/in", one.schema, f"{base}/state", ["id"], 1).count() == 11


def test_ooxml_escapes_fences_and_scores(spark):
    assert [one(spark, T.ooxml_text, x) for x in ("A_x000D_B", "_x005F_x000D_", "a_x00e9__x0041_", "plain _xZZ_", "_xD83D_")] == ["A\rB", "_x000D_", "aéA", "plain _xZZ_", "\ufffd"]
    assert one(spark, T.code_fence, "a ``` b ```` c") == "`````" and one(spark, T.code_fence, "none") == "```"
    assert one(spark, T.fenced_json, '```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, T.fenced_json, "{}") == "{}"
    rows = [(1.2, [0.1, 0.6, 0.3], True), (1.2, [0.1, 0.6, 0.4], False), (2.5, [0.0, 0.0, 1.0], False), (1.0, [0.5, 0.5], False), (None, [0.0, 1.0, 0.0], False), (1.0, [0.0, 1.0, None], False)]
    table = spark.createDataFrame(rows, "s double, p array<double>, want boolean")
    assert all(r.want == r.got for r in table.withColumn("got", T.valid_scores(F.col("s"), F.col("p"))).collect())


def test_answers_of_two_million_characters_are_read(spark):
    block = lambda text: '{"kind": "paragraph", "text": "' + text + '"}'
    answer = lambda blocks: '{"job": "j", "unit": 1, "blocks": [' + ", ".join(blocks) + "]}"
    many = answer([block(r'NaN \\\" x')] * 40_000)
    long = answer([block("y" + " " * (1_999_999 - len(answer([block("y")])) + 1))])
    rows = [(1, "j", 1, many), (2, "j", 1, long), (3, "j", 1, long + " "), (4, "j", 1, answer([block("a"), "NaN"])), (5, "j", 1, answer([block(r'\\'), "Infinity"]))]
    assert len(many) < answers.LONGEST == len(long)
    found = {r.doc_id: (r.accepted, r.reason, r.n) for r in answers.read_answers(spark.createDataFrame(rows, "doc_id long, job string, unit int, answer string")).select("doc_id", "accepted", "reason", F.size("blocks").alias("n")).collect()}
    assert found[1] == (True, None, 40_000) and found[2] == (True, None, 1)
    assert found[3][:2] == (False, "too long") and found[4][:2] == found[5][:2] == (False, "not strict JSON")


def test_answers_are_strict(spark):
    good = '{"job": "j", "unit": 1, "blocks": [{"kind": "paragraph", "text": "x NaN  "}]}'
    cases = [
        (good, None), (f"```json\n{good}\n```", None), (good.replace('"j"', '"k"'), "another job"), (good.replace('"unit"', '"unit": 1, "unit"'), "not strict JSON"), ("{", "not strict JSON"), (None, "not strict JSON"),
        (good.replace("}]}", "}], \"more\": 1}"), "keys"), (good.replace("paragraph", "poem"), "block"), (good.replace("x NaN", " "), "block"), ('{"job": "j", "unit": 1, "blocks": []}', "no blocks"),
    ]
    table = spark.createDataFrame([(k, "j", 1, a) for k, (a, _) in enumerate(cases)], "doc_id int, job string, unit int, answer string")
    found = {r.doc_id: r for r in answers.read_answers(table).collect()}
    assert [found[k].reason for k in range(len(cases))] == [r for _, r in cases]
    assert found[0].blocks[0].text == "x NaN\n\n"


def test_publishing_again_adds_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("a", "T", "/1"), ("a", "T", "/2"), ("b", "T", "/3"), (None, "T", "/4")], "sha string, title string, path string")
    ids = answers.package_ids(docs, 7, ["sha", "title"])
    assert ids.select("package_id").distinct().count() == 3
    assert answers.package_ids(docs, 8, ["sha", "title"]).join(ids, "package_id").count() == 0
    folder = str(tmp_path / "packages")
    answers.publish(ids, None, folder)
    catalog = spark.read.parquet(folder).select("package_id").withColumn("integrity_ok", F.lit(True))
    assert catalog.count() == 3 and answers.publish(ids, spark.createDataFrame(catalog.collect(), catalog.schema), folder).count() == 0
    assert spark.read.parquet(folder).count() == 3


def test_contract_rules_one_by_one(spark):
    """A sound document, one with every fault, and one that nothing was received of."""
    docs = spark.createDataFrame(
        [(1, 1, "T", [1, 2], None), (2, 2, "\u00a0 ", [1, 1, 3, 0], [3]), (3, 1, None, [1], []), (4, None, "T", None, None)],
        "doc_id int, schema_version int, title string, expected array<int>, missing_images array<int>",
    )
    rows = [
        (1, 1, 1, 1, "a", "heading", 6, "x"), (1, 2, 1, 1, "b", "paragraph", None, "[Verificar] y"),
        (2, 1, 1, 1, "a", "heading", 7, "x"), (2, 1, 2, 1, "a", "paragraph", None, "again"), (2, 9, 3, 1, "", "poem", None, " "), (2, 0, 4, 1, None, None, None, None),
    ]
    blocks = spark.createDataFrame(rows, "doc_id int, unit int, entry int, pos int, block_id string, kind string, level int, text string")
    found = sorted((r.doc_id, r.rule, r.unit or 0, r.n) for r in C.contract_faults(docs, blocks).collect())
    assert found == sorted([
        (2, "version", 0, 1), (2, "title", 0, 1), (2, "scope", 0, 1), (2, "scope_repeated", 0, 1), (2, "unit", 1, 1), (2, "unit", 9, 1), (2, "empty", 9, 1), (2, "empty", 0, 1), (2, "block", 1, 1), (2, "block", 9, 1),
        (2, "level", 1, 1), (2, "missing", 3, 1), (2, "image", 3, 1), (3, "title", 0, 1), (3, "missing", 1, 1), (4, "version", 0, 1), (4, "scope", 0, 1),
    ])
    told = {r.doc_id: r for r in C.contract_verdict(docs, blocks).collect()}
    assert (told[1].status, told[1].errors, told[1].warnings) == ("revisar", [], ["doubt 2"]) and {told[k].status for k in (2, 3, 4)} == {"parcial"}


def test_rerank_keeps_hits_without_a_score_last(spark):
    hits, scores = spark.createDataFrame([(k,) for k in (1, 2, 3)], "local_rank int"), spark.createDataFrame([(3, 2.0), (2, -1.0)], "local_rank int, score double")
    assert [r.local_rank for r in R.rerank(hits, scores, 5).collect()] == [3, 2, 1]


def test_a_text_file_is_one_unit_or_is_told_why_not(spark):
    given = [("/a/n.md", b"\xef\xbb\xbfx\n"), ("/a/b", b"\xef\xbb\xbf"), ("/a/.md", "\u2003\x1c".encode()), ("/a.b/c", b"\xff"), ("/d.txt", None), ("/e.tar.gz", "\ufeff\ufeff".encode())]
    found = {r.path: (r.title, r.unit, r.state, r.text) for r in files.text_units(spark.createDataFrame(given, "path string, content binary")).collect()}
    assert found["/a/n.md"] == ("n", 1, "unit", "x\n") and found["/a/b"] == ("b", None, "blank", None) and found["/a/.md"][2] == "blank"
    assert found["/a.b/c"] == ("c", None, "not utf-8", None) and found["/d.txt"] == ("d", None, "blank", None) and found["/e.tar.gz"] == ("e.tar", 1, "unit", "\ufeff")


def test_every_refused_file_has_a_reason(spark):
    given = [("a", "pdf", 2000), ("b", "pdf", 2001), ("c", "pdf", None), ("d", "pdf", 0), ("e", None, None), ("f", "dwg", None), ("g", "text", None), ("h", "png", 9)]
    found = {r.path: (r.route, r.reason) for r in L.entry_routes(spark.createDataFrame(given, "path string, kind string, pages long")).collect()}
    assert [found[k][0] for k in "abcdefgh"] == ["pages", "refused", "refused", "refused", "refused", "refused", "text", "native"]
    assert found["e"][1] == "unknown kind" and found["f"][1] == "no adapter for dwg" and found["a"][1] is None


def test_resolutions_need_cause_evidence_and_a_known_failure(spark):
    failures = spark.createDataFrame([("s",), ("s",), (None,)], "signature string")
    asked = spark.createDataFrame([("s", "c", "e"), ("s", "c", " "), ("s", None, "e"), ("t", "c", "e"), (None, "c", "e")], "signature string, cause string, evidence string")
    found = sorted((r.signature or "", r.cause or "", r.evidence, r.status) for r in L.resolve_failures(failures, asked).collect())
    assert [x[3] for x in found] == ["rechazado", "rechazado", "rechazado", "resuelto", "rechazado"] and len(found) == 5


def test_a_title_of_very_many_documents_is_numbered_in_parts(spark):
    titles = spark.range(3000).selectExpr("2999 - id AS doc_id", "if(id % 3 = 0, concat('t', id), if(id % 2 = 0, 'Same', 'same')) AS title")
    named = {r.doc_id: r.name for r in L.export_names(titles, most=300).collect()}
    assert named == {r.doc_id: r.name for r in L.export_names(titles).collect()}
    same = [d for d in range(3000) if (2999 - d) % 3]
    want = {d: ("Same" if (2999 - d) % 2 == 0 else "same") + (f" ({k})" if k > 1 else "") for k, d in enumerate(same, 1)}
    assert {d: named[d] for d in same} == want and len({n.lower() for n in named.values()}) == 3000
    one_id = spark.createDataFrame([(None, "a"), (7, "a"), (7, "a")], "doc_id long, title string")
    assert sorted(r.name for r in L.export_names(one_id).collect()) == ["a", "a (2)", "a (3)"]
    assert L.export_names(titles.limit(0)).count() == 0


def test_a_layer_of_very_many_vertices_is_measured_in_parts(spark):
    vertices = spark.range(2000).selectExpr("if(id < 1900, 'hot', concat('l', id % 3)) AS layer", "id AS ord", "cast(id * 2 AS double) AS x", "cast(if(id % 2 = 0, 0, 5) AS double) AS y", "if(id % 100 = 7, 1.0D, null) AS bulge")
    found = {r.layer: (round(r.length, 6), r.vertices) for r in S.path_lengths(vertices).collect()}
    rows = sorted((r.layer, r.ord, r.x, r.y, r.bulge) for r in vertices.collect())
    want = {}
    for a, b in zip(rows, [*rows[1:], (None,) * 5], strict=True):
        length, n = want.get(a[0], (0.0, 0))
        step = math.hypot(b[2] - a[2], b[3] - a[3]) * (math.pi / 2 if a[4] else 1) if a[0] == b[0] else 0.0
        want[a[0]] = (length + step, n + 1)
    assert found == {k: (round(length, 6), n) for k, (length, n) in want.items()}
    assert S.path_lengths(vertices.limit(0)).count() == 0


def test_a_hot_key_is_parted_within_itself(spark):
    """900 rows that lie together are in many stretches, and each row knows the one behind it."""
    rows = spark.range(3000).selectExpr("if(id between 1000 and 1899, 'hot', if(id % 7 = 0, null, concat('k', id % 50))) AS layer", "id AS ord", "cast(id AS double) AS x", "id % 3 * 1.0D AS y", "if(id % 5 = 0, 0.5D, 0D) AS bulge")
    rest, hot = ranges.parted(rows, "layer", ["ord"], 100)
    assert hot.filter("layer = 'hot'").select(ranges.PART).distinct().count() == 9 and hot.filter("layer = 'hot' AND ord - 1000 <> _place").count() == 0 and rest.count() + hot.count() == 3000
    plain, parts = ({r.layer: (round(r.length, 6), r.vertices) for r in S.path_lengths(rows, most).collect()} for most in (10_000, 100))
    assert plain == parts and len(parts) == 52


def test_dealt_rows_stay_in_as_many_tasks_as_they_need(spark):
    from quire.operators.ranges import dealt

    rows = spark.range(1000)
    per_task = dealt(rows, "id", most=100).groupBy(F.spark_partition_id()).count()
    assert per_task.count() == 10 and per_task.agg(F.max("count")).first()[0] < 200
    assert dealt(rows, "id", most=1000) is rows


def test_difference_is_one_pass_and_takes_nulls_as_equal(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    got = S.difference_both_ways(rows(1, 1, 2, None), rows(2, 3, 3, None), "id")
    assert sorted(map(tuple, got.collect())) == [("added", 3), ("lost", 1)]


def test_contracts_are_dealt_by_the_number_of_their_blocks(spark, monkeypatch):
    """Merged by compressed bytes, a task sorted and gathered ever more narrow rows as a table grew."""
    from quire.operators import contracts, ranges

    monkeypatch.setattr(contracts, "tasks_for", lambda rows: ranges.tasks_for(rows, 5))
    documents = spark.createDataFrame([(d, 1, "T", [1, 2], None) for d in range(10)], "doc_id int, schema_version int, title string, expected array<int>, missing_images array<int>")
    blocks = spark.createDataFrame([(d, 1, 1, k, "b" if d == 3 else f"b{k}", "paragraph", None, "t") for d in range(10) for k in range(3)], "doc_id int, unit int, entry int, pos int, block_id string, kind string, level int, text string")
    faults = contracts.contract_faults(documents, blocks)
    assert faults._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 3
    assert sorted(tuple(r) for r in faults.collect()) == sorted([(3, "block", 1, 2), *[(d, "missing", 2, 1) for d in range(10)]])
    told = contracts.contract_verdict(documents, blocks)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("REPARTITION_BY_NUM") >= 6
    assert {r.doc_id: r.errors for r in told.collect()}[3] == ["block 1", "block 1", "missing 2"]
