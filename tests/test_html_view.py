"""Markdown tokens and the HTML view on small documents."""

import pytest
from pyspark.sql import functions as F

from quire.operators import html_view as H
from quire.sources import markdown as M


def tokens(text):
    blocks = M.Blocks()
    blocks.run(text.split("\n"))
    return [(t["kind"], t.get("text"), t.get("rows")) for t in blocks.tokens]


def test_blocks():
    assert tokens("a\nb\n\n# T #\n---\n```x\n# no\n~~~\n```\n> q\n>> r\n1. one\n   more\n- two\nend") == [
        ("paragraph", "a b", None), ("heading", "T", None), ("rule", "---", None), ("code", "# no\n~~~", None), ("quote", None, None), ("paragraph", "q", None), ("quote", None, None), ("paragraph", "r", None),
        ("quote_end", None, None), ("quote_end", None, None), ("list", None, [["one more", "two"]]), ("paragraph", "end", None),
    ]
    assert tokens("| a | b |\n|---|:--:|\n| 1 |\nx") == [("table", None, [["a", "b"], ["1", ""]]), ("paragraph", "x", None)]
    assert tokens("```\nnever closed") == [("code", "never closed", None)] and tokens("\n \n") == [] and tokens("####### seven\n-\n1.x") == [("paragraph", "####### seven - 1.x", None)]
    assert len(tokens(">" * 5000 + "deep")) == 2 * M.DEEPEST + 1


def test_sheets_end_at_headings_of_two_levels_and_their_names_are_told_apart():
    blocks = M.Blocks()
    blocks.run("## Hoja: A\nfilas 3 · columnas con dato 2 · x\n### in\n## Hoja: B *(oculta)*\n| 1 |\n| 2 |\n| 3 |\n## Hoja: A\n# in\n# in".split("\n"))
    assert [(t["kind"], t.get("text"), t.get("id"), t.get("note"), t.get("flag")) for t in blocks.tokens if t["kind"] in ("sheet", "heading")] == [
        ("sheet", "A", "hoja-a", "filas 3 · columnas con dato 2 · x", False), ("heading", "in", "in", None, None), ("sheet", "B", "hoja-b", "1 filas", True), ("sheet", "A", "hoja-a-2", "sin filas", False),
        ("heading", "in", "in-2", None, None), ("heading", "in", "in-3", None, None),
    ]
    assert [t["unit"] for t in blocks.tokens if t["kind"] == "sheet"] == ["open", None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a < b & `c <x> **d**` **e** `` x", "a &lt; b &amp; <code>c &lt;x&gt; **d**</code> <strong>e</strong> `` x"),
        ("**bold** __too__ *it* a*b*c 2 * 3 * 4", "<strong>bold</strong> <strong>too</strong> <em>it</em> a*b*c 2 * 3 * 4"),
        ("\\# no \\_x <u>x</u> a<br/>b &amp;amp; &#65;", "# no _x <u>x</u> a<br>b &amp;amp; &#65;"),
        ("[go](https://e.org/a__b__c?x=1&y=2) [in](#top)", '<a href="https://e.org/a__b__c?x=1&amp;y=2" rel="noopener noreferrer" target="_blank">go</a> <a href="#top">in</a>'),
        ("[x](javascript:alert(1)) [y](data:a)", None),
        ("![pic](img/a.png) ![no](img/b.png) ![up](../x.png) ![web](http://e/x.png)", '<img src="img/a.png" alt="pic" loading="lazy"> <span class="falta">imagen ausente: img/b.png</span> <span class="falta">imagen fuera del paquete: ../x.png</span> <span class="falta">imagen remota no cargada: http://e/x.png</span>'),
        ("[a **b**](<img/a.png>)", '<a href="img/a.png">a <strong>b</strong></a>'),
        ("<script>alert('x')</script>", "&lt;script&gt;alert(&#x27;x&#x27;)&lt;/script&gt;"),
        (None, ""),
    ],
)
def test_inline(spark, text, want):
    d = spark.createDataFrame([(text, ["img/a.png"])], "t string, a array<string>")
    got = d.select(H.inline(F.col("t"), F.col("a")).alias("h")).first().h
    assert got == want if want is not None else "<a" not in got and "data:a" in got


def test_documents_views_and_stamps(spark):
    text = "# T\n[verificar: x] and [sin caché]\n> [ilegible]\n\n" + "| " + " | ".join("abcdefghij") + " |\n|" + "--|" * 10 + "\n| 1 |\n"
    docs = spark.createDataFrame([(1, "Ti<tle", text, ["a.png"]), (2, None, None, None), (3, "x", "plain", [])], "doc_id long, title string, text string, assets array<string>")
    got = {r.doc_id: r for r in H.rendered(docs).collect()}
    assert got[1].marks == 3 and got[1].tables == 1 and got[1].sheets == 0 and [t.text for t in got[1].toc] == ["T"]
    assert '<mark class="verificar" id="m1">[verificar: x]</mark> and <mark class="pendiente" id="m2">[sin caché]</mark>' in got[1].html
    assert '<blockquote>\n<p><mark class="ilegible" id="m3">[ilegible]</mark></p>\n</blockquote>' in got[1].html
    assert '<div class="tabla ancha"><div class="tabla-meta">1 filas × 10 columnas · 90 % vacías</div><table><thead><tr><th scope="col">a</th><th scope="col" class="cv">b</th>' in got[1].html
    assert '<td title="1">1</td><td class="v cv"></td>' in got[1].html
    assert (got[2].html, got[2].toc, got[2].marks) == ("", None, 0) and got[3].html == "<p>plain</p>"
    pages = {r.doc_id: r for r in H.pages(docs).collect()}
    assert pages[1].page.startswith(pages[1].stamp + "\n<!doctype html>") and "<title>Ti&lt;tle</title>" in pages[1].page and '<a class="n1" href="#t">T</a>' in pages[1].page
    views = H.pages(docs.filter("doc_id < 3")).select("doc_id", "stamp").unionByName(spark.createDataFrame([(3, "old")], "doc_id long, stamp string"))
    declared = spark.createDataFrame([(2, "vista.html"), (3, "other")], "doc_id long, name string")
    assert {r.doc_id: r.state for r in H.views_due(docs, views, declared).collect()} == {1: "written", 2: "refused", 3: "due"}


def test_documents_of_one_small_file_are_dealt_before_they_are_read(spark):
    docs = spark.range(5000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("# t\n"), "id").alias("text"))
    found = M.tokens_of(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(doc_id" in plan[plan.index("MapInArrow") :]
    assert found.groupBy("kind").count().orderBy("kind").collect() == [("heading", 5000), ("paragraph", 5000)]
