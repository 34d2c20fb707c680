"""Named exports: three sides compared, numbers, links."""

import hashlib

from quire.operators import exports as E

DOCS = "doc_id long, source_id string, title string, text string, names array<string>, base string, integrity_ok boolean"
REGISTRY, DISK = "target string, source_id string, sha256 string", "target string, sha256 string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plan(spark, docs, registry=(), disk=(), most=E.HOT):
    rows = [(i, s, t, x, ["a b.png", "document.json"], "../p", ok) for i, s, t, x, ok in docs]
    return E.plan_exports(spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(registry), REGISTRY), spark.createDataFrame(list(disk), DISK), most)


def told(df):
    return {r.doc_id: (r.action, r.target) for r in df.collect()}


def test_own_files_are_renewed_and_others_are_left(spark):
    registry = [("A.md", "s1", sha("old")), ("B.md", "s2", sha("old")), ("C.md", "s9", sha("x"))]
    disk = [("a.md", sha("old")), ("B.md", sha("edited")), ("C.md", sha("same")), ("D.md", sha("foreign")), ("D (3).md", sha("f"))]
    docs = [(1, "s1", "A", "new", True), (2, "s2", "B", "new", True), (3, "s3", "C", "same", True), (4, "s4", "D", "d", True), (5, "s5", "D", "e", True), (6, "s6", "E", "e", False), (7, "s7", None, None, True)]
    made = plan(spark, docs, registry, disk)
    assert told(made) == {1: ("overwrite", "a.md"), 2: ("create", "B (2).md"), 3: ("unchanged", "C.md"), 4: ("create", "D (2).md"), 5: ("create", "D (4).md"), 6: ("damaged", None), 7: ("create", "documento.md")}
    after = {r.target: (r.source_id, r.sha256) for r in E.exported(made, spark.createDataFrame(registry, REGISTRY)).collect()}
    assert after == {"a.md": ("s1", sha("new")), "B.md": ("s2", sha("old")), "B (2).md": ("s2", sha("new")), "C.md": ("s9", sha("x")), "D (2).md": ("s4", sha("d")), "D (4).md": ("s5", sha("e")), "documento.md": ("s7", sha(""))}


def test_a_source_is_exported_once_equal_contents_share_a_file_and_numbered_titles_keep_theirs(spark):
    docs = [(1, "s1", "A", "one", True), (2, "s1", "A", "two", True), (3, "s2", "A", "x", True), (4, "s3", "a", "x", True), (5, "s4", "A (2)", "own", True), (6, "s5", "A", "y", True)]
    assert told(plan(spark, docs)) == {1: ("superseded", None), 2: ("create", "A.md"), 3: ("create", "A (3).md"), 4: ("create", "a (3).md"), 5: ("create", "A (2).md"), 6: ("create", "A (4).md")}


def test_links_lead_into_the_package(spark):
    text = "[x](document.json) ![y](<a b.png>) [z](other.json) ](a b.png)"
    (r,) = plan(spark, [(1, "s", "T", text, True)]).collect()
    assert r.content == "[x](<../p/document.json>) ![y](<../p/a%20b.png>) [z](other.json) ](<../p/a%20b.png>)" and r.sha256 == sha(r.content)
    assert plan(spark, []).count() == 0


def test_a_title_of_very_many_documents(spark):
    docs = [(k, f"s{k}", "Hot", f"t{k}", True) for k in range(1200)]
    got = told(plan(spark, docs, disk=[("Hot (5).md", "z")], most=100))
    assert got[3] == ("create", "Hot (4).md") and got[4] == ("create", "Hot (6).md") and got[997] == ("create", "Hot (999).md") and got[998] == ("full", None)
    assert got == told(plan(spark, docs, disk=[("Hot (5).md", "z")]))


def test_no_side_of_a_plan_goes_through_the_driver(spark):
    docs = spark.createDataFrame([(k, f"s{k}", f"T {k % 3}", "text", [], "b", True) for k in range(9)], "doc_id long, source_id string, title string, text string, names array<string>, base string, integrity_ok boolean")
    none = spark.createDataFrame([], "target string, source_id string, sha256 string")
    plan = E.plan_exports(docs, none, none.select("target", "sha256"))
    for found, rows in ((plan, 9), (E.exported(plan, none), 3)):
        assert found.count() == rows and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
