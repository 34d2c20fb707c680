"""Queues, runs and what is sent or told of them: edges that the tables do not hold."""

import pytest

from quire.operators import queues as Q

SHA = "ab" * 32


def test_package_names_come_from_either_slash_and_nothing_longer(spark):
    paths = [f"C:\\m\\documentos\\{SHA}", f"/m/{SHA}-recuperado-0123abcd/", f"/m/{SHA}-recuperado-0123abc", f"/m/{SHA}\n", SHA.upper(), "", None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(Q.package_name(Q.F.col("p"))).collect()]
    assert got == [SHA, f"{SHA}-recuperado-0123abcd", None, None, None, None, None]


def test_queue_entries_need_their_texts_and_paths_of_their_own(spark):
    rows = [(1, "a", "n", "f", "s", "x", 0), (1, "b", "n", "f", "s", "x", 1), (2, "a", "n", "f", "s", "x", None), (2, None, "n", "f", "s", "x", 1), (2, None, "n", "f", "s", "x", 1), (3, "a", "n", "f", "s", "x", 1), (3, "a", "n", "f", "s", "x", 1)]
    got = {tuple(r) for r in Q.queue_contract(spark.createDataFrame(rows, "queue int, path string, name string, format string, status string, action string, bytes long")).collect()}
    assert got == {(1, 2, 0, 0, True), (2, 3, 3, 0, False), (3, 2, 0, 1, False)}


@pytest.mark.parametrize("limit", [0, 201])
def test_runs_are_bounded(spark, limit):
    with pytest.raises(ValueError, match="1 to 200"):
        Q.run_files(spark.createDataFrame([], "batch int, position int, state string"), limit)


def test_failed_files_wait_until_asked_for(spark):
    items = spark.createDataFrame([(1, k, s) for k, s in enumerate(["terminado", "error", "listo", "listo"])], "batch int, position int, state string")
    assert [r.position for r in Q.run_files(items, 1).collect()] == [2]
    assert [r.position for r in Q.run_files(items, 2, retry_errors=True).orderBy("position").collect()] == [1, 2]


def test_totals_of_nothing(spark):
    got = Q.rule_totals(spark.createDataFrame([], "package int, rule string")).select("rule", "findings", "packages").collect()
    assert [tuple(r) for r in got] == [(None, 0, 0)]


def test_refused_judgements_have_no_body(spark):
    schema = "query_id int, query string, document_id string, unit int, block_id string, excerpt string, excerpt_truncated boolean, rank int"
    hit = lambda q, query="ask", d=SHA, unit=1, block="b", text="t", cut=None, rank=1: (q, query, d, unit, block, text, cut, rank)
    rows = [hit(1, rank=2), hit(1, unit=2, text='"', cut=True), hit(2, query=" \n"), *[hit(3, unit=k + 1) for k in range(11)], hit(4, unit=0), hit(5), hit(5), hit(6, text="x" * 5001), hit(7, d=None), hit(8, text=None), hit(9, query="q" * 2001)]
    got = {r.query_id: (r.candidates, r.fault, r.body) for r in Q.judgement_payloads(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: None, 2: "query", 3: "candidates", 4: "identity", 5: "repeated", 6: "excerpt", 7: "identity", 8: "excerpt", 9: "query"}
    assert all(v[2] is None for k, v in got.items() if k > 1)
    assert got[1][2] == f'{{"query":"ask","candidates":[{{"document_id":"{SHA}","unit":2,"block_id":"b","text":"\\"","truncated":true}},{{"document_id":"{SHA}","unit":1,"block_id":"b","text":"t","truncated":false}}]}}'


def test_excerpts_are_dealt_by_their_bytes_and_do_not_sort(spark, monkeypatch):
    """Merged by compressed bytes, a task sorted a hundred thousand excerpts of twelve kilobytes and spilled them."""
    monkeypatch.setattr(Q, "TASK_BYTES", 20_000)
    schema = "query_id int, query string, document_id string, unit int, block_id string, excerpt string, excerpt_truncated boolean, rank int"
    rows = [(q, "ask", SHA, u, "b", "漢" * 4000, False, u) for q in range(8) for u in range(1, 2 + q % 2 * 5)]
    told = Q.judgement_payloads(spark.createDataFrame([*rows, (None, "ask", SHA, 1, "b", "t", False, 1)], schema))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert {r.query_id: (r.candidates, r.fault, r.body is None) for r in told.collect()} == {None: (1, None, True)} | {q: (6, "size", True) if q % 2 else (1, None, False) for q in range(8)}
