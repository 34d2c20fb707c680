"""Resumable bounded ingestion: a file stream in micro-batches, each item at most once per key across runs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.session import shared_dir


def ingest(spark: SparkSession, source: str, schema, state: str, keys: list[str], max_files: int = 4) -> DataFrame:
    """Take what is new in source (Parquet files) since the last run with this state folder; all items taken so far.

    Each run goes through the new files in micro-batches of max_files and stops. The checkpoint remembers the
    files; the items taken remember the keys: a batch is joined against what earlier batches have published and
    written under its own number, so a batch that is run again writes the same place anew, an item that comes
    again, in the same run or a later one, is not taken twice, and no state grows in memory.
    """
    items, fields = f"{state}/items", StructType([*schema.fields, StructField("batch", LongType())])

    def taken() -> DataFrame:
        return spark.read.schema(fields).parquet(items)

    spark.createDataFrame([], schema).write.mode("append").parquet(f"{items}/batch=-1")

    def publish(batch: DataFrame, number: int) -> None:
        old = taken().filter(F.col("batch") != number).select(*keys)
        same = reduce(lambda a, b: a & b, (batch[k].eqNullSafe(old[k]) for k in keys))
        batch.dropDuplicates(keys).join(old, same, "left_anti").write.mode("overwrite").parquet(f"{items}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = stream.writeStream.foreachBatch(publish).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return taken().drop("batch")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in several files, some of them twice, taken in two runs; counts by type."""
    base = f"{shared_dir(spark)}/quire/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("value"))
    half = F.col("event_id") % 2
    events.filter(half == 0).repartition(3).write.parquet(f"{base}/in")
    ingest(spark, f"{base}/in", events.schema, f"{base}/state", ["event_id"], 2)
    events.filter((half == 1) | (F.col("event_id") % 10 == 0)).repartition(3).write.mode("append").parquet(f"{base}/in")
    taken = ingest(spark, f"{base}/in", events.schema, f"{base}/state", ["event_id"], 2)
    return taken.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
