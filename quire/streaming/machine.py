"""Items that go from state to state as events come in: illegal steps are refused, what was running is resumed.

The states are a table that each micro-batch changes by a swap: it reads the buckets that its events fall into, works
out their items, and publishes these buckets anew; a batch that is run again finds its number in the version and does
nothing. Progress is told by version: how many items are done, of how many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from quire.sources.swaps import BUCKET, Swap

#: Where each event leads from each state; no other step is legal.
STEPS = {
    ("listo", "start"): "en_curso",
    ("en_curso", "finish"): "terminado",
    ("en_curso", "fail"): "error",
    ("en_curso", "interrupt"): "listo",
    ("error", "retry"): "en_curso",
}
BEGIN, RUNNING, DONE = "listo", "en_curso", ("terminado", "error")
ITEM = "item string, state string, last bigint, steps bigint, refused bigint, resumed bigint"


def stepped(item: Column, events: Column) -> Column:
    """An item (state, last, steps, refused) after events (seq, event) in order; an event that is not newer than the last one is refused."""
    legal = F.create_map(*[F.lit(x) for (state, event), to in STEPS.items() for x in (f"{state} {event}", to)])

    def step(now: Column, e: Column) -> Column:
        to = F.when(e["seq"] > now["last"], F.try_element_at(legal, F.concat_ws(" ", now["state"], e["event"])))
        return F.struct(
            F.coalesce(to, now["state"]).alias("state"), F.greatest(now["last"], e["seq"]).alias("last"), (now["steps"] + to.isNotNull().cast("long")).alias("steps"), (now["refused"] + to.isNull().cast("long")).alias("refused")
        )

    return F.aggregate(events, item, step)


class Progress(StreamingQueryListener):
    """What a running query has taken so far: rows and batches, as it tells them."""

    def __init__(self):
        self.rows, self.batches, self.ended = 0, 0, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.batches += event.progress.numInputRows > 0

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended += 1


class Machine:
    """The items of a folder. plan: items that are ready, or pendiente and never run."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.table = Swap(spark, f"{self.folder}/items", StructType.fromDDL(ITEM), "item", buckets)

    def plan(self, items: DataFrame) -> None:
        """Add items (item, state) that are not there yet; those that are keep their state."""
        now = self.table.current()
        old = self.table.read(now)
        zero = F.lit(0).cast("long")
        new = items.groupBy("item").agg(F.min("state").alias("state")).join(old.select("item"), "item", "left_anti").withColumns({"last": F.lit(-1).cast("long"), "steps": zero, "refused": zero, "resumed": zero})
        self.table.replace(old.unionByName(new), now, note=now["note"])

    def resume(self) -> None:
        """Before a run: what an earlier run has left running is ready again."""
        now = self.table.current()
        running = F.col("state") == RUNNING
        rows = self.table.read(now).withColumns({"resumed": F.col("resumed") + running.cast("long"), "state": F.when(running, BEGIN).otherwise(F.col("state"))})
        self.table.replace(rows, now, note=now["note"])

    def publish(self, events: DataFrame, number: int) -> None:
        """A micro-batch of events (item, seq, event). An item's events of one batch are gathered: a batch bounds them. Events of unplanned items count as refused."""
        now = self.table.current()
        if now["note"] is not None and now["note"] >= number:
            return
        events = events.filter("item IS NOT NULL").persist()
        touched = [r[0] for r in events.select(self.table.bucket().alias(BUCKET)).distinct().collect()]  # at most the number of buckets
        told = events.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("events"))
        rows = self.table.read(now, touched).join(told, "item", "left").withColumn("s", F.when(F.col("events").isNotNull(), stepped(F.struct("state", "last", "steps", "refused"), F.col("events"))))
        rows = rows.select("item", *[F.coalesce(f"s.{c}", c).alias(c) for c in ("state", "last", "steps", "refused")], "resumed")
        self.table.replace(rows, now, touched, note=number)
        events.unpersist()

    def run(self, source: str, schema: StructType, max_files: int = 4) -> None:
        """Take what is new in source (Parquet files) in micro-batches of max_files, and stop."""
        self.resume()
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
        stream.writeStream.foreachBatch(self.publish).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def items(self) -> DataFrame:
        return self.table.read()

    def progress(self) -> DataFrame:
        """done, total, version: items that need nothing more, of all that are not left out of the plan."""
        now = self.table.current()
        rows = self.table.read(now).filter("state <> 'pendiente'")
        return rows.agg(F.count_if(F.col("state").isin(*DONE)).alias("done"), F.count(F.lit(1)).alias("total")).withColumn("version", F.lit(now["version"]))
