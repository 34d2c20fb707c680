"""Numbers and neighbours within keys, of which one may hold most rows: hot keys are ordered by range, in many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import settled

#: Rows of a key that one task may order; keys of more are hot.
HOT = 1_000_000
#: Narrow rows that a task may sort or count by key.
TASK_ROWS = 400_000
KEY, PART, PLACE = "_key", "_part", "_place"


def key_of(key: str) -> Column:
    """A key such that null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def hot_keys(df: DataFrame, key: str, most: int = HOT) -> DataFrame:
    """The keys (as key_of) of more rows than most: counts are combined before they move, and few are left."""
    return df.groupBy(key_of(key).alias(KEY)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(KEY)


def parted(df: DataFrame, key: str, order: Sequence[str], most: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that are not hot; and those that are, with _part and _place: a stretch of at most most rows of
    its key, in order, and the row's number in its key from 0. None if no key is hot.

    Hot rows alone are sorted by key and order over all tasks and written; their places are told by what was counted
    before them, a row a task and key.
    """
    hot = settled(hot_keys(df, key, most), "hot")
    if not hot.limit(1).count():
        return df, None
    keyed = df.withColumn(KEY, key_of(key))
    rest = keyed.join(hot, KEY, "left_anti").drop(KEY)
    rows = keyed.join(F.broadcast(hot) if hot.count() < 1000 else hot, KEY, "left_semi").withColumn("_tie", F.monotonically_increasing_id())
    by = [KEY, *order, "_tie"]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // most + 1)
    dealt = settled(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("_task", F.shiftright("_at", 33))
    counts = dealt.groupBy(KEY, "_task").agg(F.count(F.lit(1)).alias("rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(KEY).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    begins = settled(counts.select(F.col(KEY).alias("k_"), F.col("_task").alias("t_"), "_first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_begin")), "begins")
    placed = dealt.join(begins, (F.col(KEY) == F.col("k_")) & (F.col("_task") == F.col("t_"))).withColumn(PLACE, F.col("_begin") + F.col("_at") - F.col("_first"))
    return rest, placed.withColumn(PART, F.floor(F.col(PLACE) / most)).drop("k_", "t_", "_first", "_begin", "_at", "_task")


def numbered(df: DataFrame, key: str, order: Sequence[str], name: str = "nth", most: int = HOT) -> DataFrame:
    """df with the number of each row within its key, from 1."""
    rest, hot = parted(df, key, order, most)
    own = rest.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return own if hot is None else own.unionByName(hot.withColumn(name, (F.col(PLACE) + 1).cast("int")).drop(KEY, PART, PLACE))


def followed(df: DataFrame, key: str, order: str, values: Sequence[str], most: int = HOT) -> DataFrame:
    """df with next, the struct of values in the row behind within its key: null for the last."""
    rest, hot = parted(df, key, [order], most)
    own = rest.withColumn("next", F.lead(F.struct(*values)).over(Window.partitionBy(key).orderBy(order)))
    if hot is None:
        return own
    inside = Window.partitionBy(KEY, PART).orderBy(PLACE)
    first = hot.filter(F.col(PLACE) % most == 0).select(F.col(KEY).alias("k_"), (F.col(PART) - 1).alias("p_"), F.struct(*values).alias("after"))
    told = hot.withColumn("next", F.lead(F.struct(*values)).over(inside)).join(first, (F.col(KEY) == F.col("k_")) & (F.col(PART) == F.col("p_")), "left")
    return own.unionByName(told.withColumn("next", F.coalesce("next", "after")).drop("k_", "p_", "after", KEY, PART, PLACE))


def tasks_for(rows: int, most: int = TASK_ROWS) -> int:
    """Tasks that hold at most about `most` rows each."""
    return max(1, -(-rows // most))


def dealt(df: DataFrame, *key: str, most: int = TASK_ROWS) -> DataFrame:
    """df dealt by key to as many tasks as its rows need.

    Adaptive execution merges partitions by their compressed bytes, so that of narrow rows a task gets ever more as a
    table grows; it leaves a number that is told. A table of one task's rows stays as it is.
    """
    return dealt_to(df, tasks_for(df.count(), most), *key)


def dealt_to(df: DataFrame, tasks: int, *key: str) -> DataFrame:
    """df dealt by key to this number of tasks; as it is for one."""
    return df.repartition(tasks, *key) if tasks > 1 else df


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with its table: a broadcast, which Spark picks by compressed bytes, would go through the driver."""
    return side.hint("merge")
