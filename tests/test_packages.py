"""Packages, batches and views on small and odd inputs."""

import pytest
from pyspark.sql import functions as F

from quire.operators import packages as P
from quire.operators import views as V


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pages_missing_empty_ambiguous(spark):
    expected = spark.createDataFrame([(1, [1, 2, 3, 10])], "doc_id long, expected array<int>")
    files = spark.createDataFrame([(1, "a.b_p1.md", "x"), (1, "a.b_p2.md", "﻿ "), (1, "a.b_p3.md", "y"), (1, "a.b_p003.md", "z"), (1, "axb_p10.md", "no"), (1, None, "no")], "doc_id long, name string, text string")
    assert rows(P.import_pages(expected, files, "a.b").select("unit", "state", "text")) == [(1, "imported", "x"), (10, "missing", None), (2, "empty", None), (3, "ambiguous", None)]


def test_merge_refuses_absent_and_repeated_units(spark):
    items = spark.createDataFrame([(1, 0, 7, "a"), (1, 1, 8, "b"), (2, 0, 7, "a"), (2, 1, 9, "c"), (2, 2, 8, None)], "batch int, position int, unit int, package string")
    units = spark.createDataFrame([("a", 7, "A"), ("b", 8, "B"), ("c", 9, "C"), ("c", 9, "D")], "package string, unit int, text string")
    assert rows(P.merge_batch(items, units)) == [(1, 2, 2, "", "published", "AB"), (2, 3, 1, "9: several, 8: absent", "refused", None)]
    assert P.merge_batch(items.limit(0), units).count() == 0


def test_a_reserved_signature_is_never_sent_again(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")], "job int, signature string")
    ledger = spark.createDataFrame([("b", None), ("c", None), ("c", "answer")], "signature string, response string")
    assert rows(P.reserve(jobs, ledger).select("job", "action")) == [(1, "send"), (2, "wait"), (3, "review"), (4, "reuse"), (5, "reuse")]


def test_orphans_deletions_manifest(spark):
    batches = spark.createDataFrame([(1, "a", None), (2, "a", "z"), (3, None, None), (4, "y", "a")], "batch int, source string, output string")
    assert rows(P.orphan_batches(batches, spark.createDataFrame([("a",)], "package string"))) == [(2,), (4,)]
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "doc_id int")
    assert rows(P.deletions(ids(1, 1, 2, 3), ids(1, 2, 2), ids(2))) == [(1, "deleted"), (2, "failed"), (3, "unknown")]
    file = lambda *r: spark.createDataFrame(list(r), "file string, sha256 string")
    assert rows(P.manifest_problems(file(("a", "1"), ("b", "2"), ("c", "3")), file(("a", "1"), ("b", None), ("d", "9")))) == [("b", "modificado"), ("c", "ausente")]


def test_plan_ids_tell_order_and_policy_and_refuse_long_plans(spark):
    items = spark.createDataFrame([(1, 0, 1, "x"), (1, 1, 2, "y"), (2, 1, 1, "x"), (2, 0, 2, "y"), (3, 0, 1, "x"), (3, 1, 2, "y")], "batch int, position int, unit int, sha256 string")
    found = {r.batch: r.plan_id for r in P.plan_ids(items, "p").collect()}
    assert found[1] == found[3] != found[2]
    assert found[1] != {r.batch: r.plan_id for r in P.plan_ids(items, "q").collect()}[1]
    assert P.plan_ids(spark.range(201).selectExpr("1 batch", "id position", "id unit", "'x' sha256"), "p").first().plan_id is None


def test_history_limit(spark):
    runs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "run int, started string")
    told = spark.createDataFrame([(3, 5), (3, None), (1, 9)], "run int, tokens int")
    assert rows(P.run_history(runs, told, told.filter("run = 9").select("run"), 2)) == [(2, "b", None, 0), (3, "b", 5, 0)]
    with pytest.raises(ValueError):
        P.run_history(runs, told, told, 0)


def test_index_lines_and_written_order(spark, tmp_path):
    catalog = spark.createDataFrame([(2, "B [x]", "revisar", True, 1, 2, 0), (1, "A\nb", "parcial", False, 0, 1, 3)], "doc_id int, title string, status string, integrity_ok boolean, received int, expected int, warnings int")
    index = P.library_index(catalog)
    assert [r.line for r in index.collect()] == ["- [A b](<documentos/1/documento.md>) — **parcial**, integridad dañada.", "- [B (x)](<documentos/2/documento.md>) — **revisar**, 1/2 unidades; 0 avisos."]
    P.write_lines(index, str(tmp_path / "index"))
    assert spark.read.text(str(tmp_path / "index")).count() == 2


def test_failure_without_resolutions_has_an_empty_history(spark):
    failures = spark.createDataFrame([("a", 1), ("b", 2)], "signature string, last_seen int")
    solved = spark.createDataFrame([("a", 5, "late"), ("a", 3, "early")], "signature string, resolved_at int, cause string")
    assert [(r.signature, [h.cause for h in r.history]) for r in P.failure_report(failures, solved).collect()] == [("b", []), ("a", ["early", "late"])]


def test_list_levels_follow_the_item_before(spark):
    items = spark.createDataFrame([(1, k, listed, level) for k, (listed, level) in enumerate([(True, 5), (True, 5), (True, 0), (True, 4), (False, 9), (True, 2)])], "doc_id int, ord int, is_list boolean, level int")
    assert [r.nested for r in P.list_levels(items).orderBy("ord").collect()] == [0, 1, 0, 1, None, 0]


def test_usage_is_unknown_if_a_part_is(spark):
    d = spark.createDataFrame([(1, 2), (1, None), (1, -1), (0, 0)], "a int, b int")
    assert [r[0] for r in d.select(P.summed_usage(F.col("a"), F.col("b"))).collect()] == [3, None, None, 0]


@pytest.mark.parametrize(
    "text, shape",
    [
        ("| a | b |\n|---|:--:|\n| 1 | |\n", (1, 2, False, 50, 1)),
        ("| a |\n| | c |\n", (2, 2, False, 50, 0)),
        ("| a |\n|---|\n", (0, 1, False, 0, 1)),
        ("", (0, 0, False, 0, 0)),
        ("|", (1, 1, False, 100, 1)),
        ("|" + "x|" * 13, (1, 13, True, 0, 0)),
    ],
)
def test_table_shape(spark, text, shape):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(V.table_shape(F.col("t")).alias("s")).select("s.*").first()) == shape


def test_dimension_text(spark):
    d = spark.createDataFrame([(None, 2.0), ("", 2.50004), ("<> mm", 0.5), (" . ", 1.0), ("%%c<>", None), ("free", 1.0)], "t string, m double")
    assert [r[0] for r in d.select(V.dimension_text(F.col("t"), F.col("m"))).collect()] == ["2", "2.5", "0.5 mm", "", "Ø?", "free"]


def test_encoding_faults(spark):
    d = spark.createDataFrame([("a", b"\xef\xbb\xbfok"), ("b", b"\xff\xfe"), ("c", b"a\x00b\x85".replace(b"\x85", b"\xc2\x85")), ("d", b"a\tb\r\n"), ("e", b""), ("f", None)], "path string, content binary")
    assert rows(V.encoding_faults(d)) == [("a", "B1", 1), ("b", "B2", 1), ("c", "B3", 2)]


def test_section_faults(spark):
    from quire.operators import documents as D

    texts = [(1, "# a\n\n## b\n\nprose\n"), (2, "# a\n# b\n"), (3, "# x.xml\n\n```\ncode\n"), (4, "~~~~\n```\n~~~~\n"), (5, "```\n"), (6, "")]
    units = spark.createDataFrame([(k, 1, t) for k, t in texts], "doc_id int, unit int, text string")
    assert rows(V.section_faults(D.parse_blocks(units)).select("doc_id", "rule")) == [(2, "E3"), (2, "E3"), (3, "A5"), (3, "E1"), (5, "A5")]


def test_closed_polylines_return(spark):
    from quire.operators.sheets import polyline_lengths

    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    v = [("a", 1, k, x, y, 0.0, True) for k, (x, y) in enumerate(square)] + [("a", 2, k, x, y, None, None) for k, (x, y) in enumerate(square)]
    v += [("b", 1, 0, 0.0, 0.0, 1.0, True), ("b", 1, 1, 2.0, 0.0, 1.0, True), ("c", 1, 0, 5.0, 5.0, 1.0, True)]
    found = {r.layer: (round(r.length, 6), r.paths) for r in polyline_lengths(spark.createDataFrame(v, "layer string, path int, ord int, x double, y double, bulge double, closed boolean")).collect()}
    assert found == {"a": (14.0, 2), "b": (3.141593, 1), "c": (0.0, 1)}


def test_labels(spark):
    from quire.functions import text as T

    d = spark.createDataFrame([("Code", 27), ("", 1), (None, 2), ("C", 3)], "h string, c int")
    assert [r[0] for r in d.select(T.header_label(F.col("h"), F.col("c"))).collect()] == ["Code [AA]", "A", "B", "C"]
    d = spark.createDataFrame([("Tabla12",), ("My_table",), (None,), ("a<br />b|c",)], "n string")
    assert [r[0] for r in d.select(T.table_heading(F.col("n"), F.lit("-"))).collect()] == ["-", "My table", "-", "a — b&#124;c"]


def test_a_merge_keeps_the_tasks_that_its_rows_need(spark, monkeypatch):
    """Partitions of a number that is told are not merged again by their compressed bytes."""
    items = spark.createDataFrame([(1, 2, 9, "p"), (1, 1, 1, "p"), (2, 1, 3, "p")], "batch long, position int, unit int, package string")
    units = spark.createDataFrame([("p", 1, "a"), ("p", 9, "b")], "package string, unit int, text string")
    told = lambda: sorted((r.batch, r.merged, r.problems, r.markdown) for r in P.merge_batch(items, units).collect())
    one = told()
    monkeypatch.setattr(P, "tasks_for", lambda rows: 3)
    assert told() == one == [(1, 2, "", "ab"), (2, 0, "3: absent", None)]
    assert "REPARTITION_BY_NUM" in P.merge_batch(items, units)._jdf.queryExecution().executedPlan().toString()
