"""One place for session settings; a cluster's own settings win."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "quire") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


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


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: what several branches of a plan use is worked out once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
