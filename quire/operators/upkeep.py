"""Deletion and repair of a library as one plan: steps in their order, failures apart, and the index of what remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .library import repair_plan
from .packages import library_index, orphan_batches

#: Fixed value: what a package's identity looks like.
IDENTITY = "^[0-9a-f]{64}(-recuperado-[0-9a-f]{8})?$"
STEP = "step int, action string, id string, outcome string, reason string"


def _step(df: DataFrame, step: int, action: Column | str, name: str, outcome: Column | str = "done", reason: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.lit(step).alias("step"), lit(action).alias("action"), F.col(name).cast("string").alias("id"), lit(outcome).alias("outcome"), (reason if reason is not None else F.lit(None).cast("string")).alias("reason"))


def _purged(batches: DataFrame, catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """batch: those that point to a package which the catalog and the disk no longer hold intact."""
    intact = catalog.join(folders.filter("integrity_ok").select("output"), "output", "left_semi").select(F.col("doc_id").alias("package"))
    return orphan_batches(batches, intact)


def delete(requested: DataFrame, catalog: DataFrame, folders: DataFrame, kept: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The steps of a deletion, and the catalog that remains.

    requested: doc_id; catalog: doc_id, output and what the index tells; folders: output, integrity_ok; kept: output of
    folders that would not go; batches: batch, source, output. Each package stands for itself: one that is no identity,
    is not in the catalog, or whose folder stays is told as failed and keeps its rows. A package without a folder
    loses its rows. Batches that point to what is gone are purged after that, if anything was deleted, and the index
    is written last.
    """
    asked = requested.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    rows = asked.join(catalog.select("doc_id", "output"), "doc_id", "left")
    rows = rows.join(folders.select("output", F.lit(True).alias("there")).distinct(), "output", "left").join(kept.select("output", F.lit(True).alias("stays")).distinct(), "output", "left")
    reason = F.when(~F.coalesce(F.rlike("doc_id", F.lit(IDENTITY)), F.lit(False)), "no identity").when(F.col("output").isNull(), "not in the catalog").when(F.col("stays") & F.col("there"), "the folder stays")
    told = rows.withColumn("reason", reason)
    gone = told.filter("reason IS NULL")
    remaining = catalog.join(gone.select("doc_id"), "doc_id", "left_anti")
    left = folders.join(gone.select("output"), "output", "left_anti")
    purged = _purged(batches, remaining, left) if gone.limit(1).count() else batches.select("batch").limit(0)
    steps = _step(told.filter("reason IS NOT NULL"), 1, "check", "doc_id", "failed", F.col("reason")).unionByName(_step(gone.filter("there"), 2, "discard_folder", "output")).unionByName(_step(gone, 3, "delete_rows", "doc_id"))
    steps = steps.unionByName(_step(purged, 4, "purge_batch", "batch"))
    written = gone.limit(1).select(F.lit("index").alias("id"))
    return steps.unionByName(_step(written, 5, "write_index", "id")), remaining


def repair(catalog: DataFrame, folders: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The steps of a repair, and the catalog after it: rows without a folder go, intact folders without a row come
    back (what the index tells of them is in folders), damaged ones are told; then batches, then the index.

    catalog: doc_id and the columns of the index; folders: doc_id, integrity_ok and those columns; no package is touched.
    """
    plan = repair_plan(catalog.select("doc_id"), folders.select("doc_id", "integrity_ok"))
    order = F.when(F.col("action") == "prune", 1).when(F.col("action") == "adopt", 2).otherwise(3)
    first = plan.select(order.alias("step"), "action", F.col("doc_id").cast("string").alias("id"), F.when(F.col("action") == "damaged", "reported").otherwise("done").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    kept = catalog.join(plan.filter("action = 'prune'").select("doc_id"), "doc_id", "left_anti")
    adopted = folders.join(plan.filter("action = 'adopt'").select("doc_id"), "doc_id", "left_semi").select(*catalog.columns)
    after = kept.unionByName(adopted)
    intact = after.join(folders.filter("integrity_ok").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("package"))
    purged = _step(orphan_batches(batches, intact), 4, "purge_batch", "batch")
    written = catalog.sparkSession.range(1).select(F.lit("index").alias("id"))
    return first.unionByName(purged).unionByName(_step(written, 5, "write_index", "id")), after


def index_of(catalog: DataFrame) -> DataFrame:
    """The index's lines of a catalog (see library_index)."""
    return library_index(catalog).select("title", "doc_id", "line")
