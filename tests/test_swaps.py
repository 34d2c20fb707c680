"""Swapped tables, recovered places and the items' machine."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.sources import swaps
from quire.streaming import machine

ROW = StructType().add("k", "long").add("v", "string")


def test_a_reader_sees_whole_versions_and_the_second_writer_is_refused(spark, tmp_path):
    table = swaps.Swap(spark, str(tmp_path / "t"), ROW, "k", 4)
    assert table.read().count() == 0 and table.current()["version"] == 0
    zero = table.current()
    one = table.replace(spark.createDataFrame([(k, "a") for k in range(20)], ROW), zero)
    pinned = table.read()
    with pytest.raises(swaps.Conflict):
        table.replace(spark.createDataFrame([(1, "late")], ROW), zero)
    (tmp_path / "t" / "versions" / "2").write_text('{"version": 2, "parts": {}}\nhalf written')
    assert table.current() == one and table.read().count() == 20
    (tmp_path / "t" / "versions" / "2").unlink()
    b = spark.range(20).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("b")).collect()
    some = {r.b for r in b if r.k in (3, 4)}
    kept = [(r.k, "b") for r in b if r.b in some]
    table.replace(spark.createDataFrame(kept, ROW), one, some)
    assert sorted(map(tuple, table.read().collect())) == sorted(kept + [(r.k, "a") for r in b if r.b not in some])
    assert sorted(map(tuple, table.read(buckets=some).collect())) == sorted(kept) and {r.v for r in pinned.collect()} == {"a"}
    table.replace(spark.createDataFrame([], ROW), table.current())
    assert table.read().count() == 0


def test_damaged_packages_are_placed_beside(spark):
    packages = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("d",)], "package_id string")
    catalog = spark.createDataFrame([("a", "a-recuperado-00000001", True), ("a", "a", False), ("b", "b", False)], "package_id string, output string, integrity_ok boolean")
    folders = spark.createDataFrame([("a",), ("a-recuperado-00000001",), ("b",), ("d-recuperado-00000002",)], "output string")
    got = {r.package_id: (r.action, r.output) for r in swaps.placed_packages(packages, catalog, folders).collect()}
    assert got["a"] == ("reuse", "a-recuperado-00000001") and got["c"] == ("publish", "c")
    assert [got[k][0] for k in "bd"] == ["recover", "recover"] and got["b"][1].startswith("b-recuperado-") and got["b"][1] not in {r.output for r in folders.collect()}


def test_a_batch_that_comes_again_changes_nothing_and_what_was_running_is_resumed(spark, tmp_path):
    made = machine.Machine(spark, str(tmp_path / "m"), 4)
    made.plan(spark.createDataFrame([("a", "listo"), ("b", "listo"), ("p", "pendiente")], "item string, state string"))
    events = lambda *rows: spark.createDataFrame(list(rows), "item string, seq long, event string")
    first = events(("a", 1, "start"), ("a", 2, "finish"), ("b", 5, "start"), ("p", 1, "start"), ("x", 1, "start"), (None, 1, "start"))
    made.publish(first, 0)
    made.publish(first, 0)
    told = lambda: {r.item: (r.state, r.steps, r.refused, r.resumed) for r in made.items().collect()}
    assert told() == {"a": ("terminado", 2, 0, 0), "b": ("en_curso", 1, 0, 0), "p": ("pendiente", 0, 1, 0)}
    made.resume()
    made.publish(events(("b", 4, "start"), ("b", 6, "finish"), ("b", 7, "start"), ("a", 3, "start")), 1)
    assert told() == {"a": ("terminado", 2, 1, 0), "b": ("en_curso", 2, 2, 1), "p": ("pendiente", 0, 1, 0)}
    made.plan(spark.createDataFrame([("a", "listo"), ("c", "listo")], "item string, state string"))
    assert made.progress().first()[:2] == (1, 3)


def test_a_listener_tells_rows_and_batches(spark, tmp_path):
    listener = machine.Progress()
    spark.streams.addListener(listener)
    try:
        rows = spark.createDataFrame([(f"i{k}", k, "start") for k in range(30)], "item string, seq long, event string")
        rows.repartition(3).write.parquet(str(tmp_path / "in"))
        made = machine.Machine(spark, str(tmp_path / "m"), 2)
        made.plan(rows.select("item", F.lit("listo").alias("state")))
        made.run(str(tmp_path / "in"), rows.schema, 1)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert (listener.rows, listener.batches) == (30, 3) and made.items().filter("state = 'en_curso'").count() == 30
