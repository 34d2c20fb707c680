"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = "[\\x20\\x09-\\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A broadcast of more rows than this is never asked for; beyond it the operators shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local master may use a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quire.scratch.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master or 'this cluster'} share")
        found = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("quire.scratch.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores as set it apart from every column of df."""
    taken, end = {c.lower() for c in df.columns}, "_"
    while any(f"_{n}{end}" in taken for n in names):
        end += "_"
    return [f"_{n}{end}" for n in names]


def few(df: DataFrame) -> bool:
    """Whether df has at most BROADCAST_ROWS rows; counts no further."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """df for a join: told to be broadcast if it has few rows, else left to a shuffle."""
    return F.broadcast(df) if few(df) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+"), "")


def id_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most buckets - 1 rising cut points that part the values of an integer column evenly."""
    if buckets < 2:
        return []
    marks = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, marks, 20 * buckets).alias("marks")).first()["marks"]
    return sorted(set(found or []))


def bucket_of(column: str, bounds: list[int]) -> Column:
    """How many bounds lie below the value: 0 for null."""
    if not bounds:
        return F.lit(0)
    marks = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    below = F.size(F.filter(marks, lambda b: b < F.col(column)))
    return F.coalesce(below, F.lit(0)).cast("int")
