"""Tables that are published as a swap: a reader sees one whole version, whatever a writer is doing or has left undone.

A version is a small pointer file, written last: which folder of data each bucket has, and its own checksum. Data are
never written over. A writer that fails leaves data that no pointer names; of two writers of one version the second
finds the pointer there and is refused. A change of some buckets writes these alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to follow."""


class Swap:
    """A table of rows with a key, in buckets by its hash, below a folder that all readers and writers share."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, buckets: int = 16):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        self.pointers = f"{self.folder}/versions"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self, path) -> dict | None:
        """A pointer's content; None if it is not whole."""
        _, fs = self._path(self.pointers)
        stream = fs.open(path)
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()
        body, _, check = text.rpartition("\n")
        return json.loads(body) if sha256(body.encode()).hexdigest() == check else None

    def current(self) -> dict:
        """The newest whole version: version, parts (a folder a bucket), note. Version 0 has nothing."""
        where, fs = self._path(self.pointers)
        names = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
        for path in sorted((p for p in names if p.getName().isdigit()), key=lambda p: int(p.getName()), reverse=True):
            if (found := self._load(path)) is not None:
                return found
        return {"version": 0, "parts": {}, "note": None}

    def read(self, version: dict | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version (the current one if not told), of some buckets or all."""
        found = version or self.current()
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [p for b, p in sorted(found["parts"].items()) if wanted is None or b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, after: dict, touched: Iterable[int] | None = None, note: object = None) -> dict:
        """Publish rows as the version after one that was read: they are all there is in the touched buckets (all if not told)."""
        touched = list(range(self.buckets)) if touched is None else sorted(touched)
        place = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()).write.partitionBy(BUCKET).parquet(place)
        _, fs = self._path(place)
        parts = dict(after["parts"])
        for b in touched:
            path = f"{place}/{BUCKET}={b}"
            parts.pop(str(b), None)
            if fs.exists(self._path(path)[0]):
                parts[str(b)] = path
        return self._publish({"version": after["version"] + 1, "parts": parts, "note": note})

    def _publish(self, pointer: dict) -> dict:
        path, fs = self._path(f"{self.pointers}/{pointer['version']}")
        body = json.dumps(pointer, sort_keys=True)
        try:
            stream = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise Conflict(f"version {pointer['version']} is there already") from e
            raise
        try:
            stream.write(bytearray(f"{body}\n{sha256(body.encode()).hexdigest()}".encode()))
        finally:
            stream.close()
        return pointer


def placed_packages(packages: DataFrame, catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """package_id, output, action: where packages are published, nothing being written over.

    catalog: package_id, output, integrity_ok; folders: output, what is on disk whether the catalog knows it or not.
    `reuse` where the catalog has the package intact. Else `publish` at its own id if no such folder is there, or
    `recover` beside it: the id, `-recuperado-` and eight digits that tell how often the package was placed before.
    """
    own = packages.select("package_id").distinct()
    fine = catalog.filter("integrity_ok").groupBy("package_id").agg(F.min("output").alias("intact"))
    there = folders.select("output", F.regexp_extract("output", "^(.*?)(-recuperado-[0-9a-f]{8})?$", 1).alias("package_id")).distinct()
    placed = there.groupBy("package_id").agg(F.count(F.lit(1)).alias("times"), F.bool_or(F.col("output") == F.col("package_id")).alias("held"))
    told = own.join(fine, "package_id", "left").join(placed, "package_id", "left")
    digits = F.substring(F.sha2(F.concat_ws("|", "package_id", "times"), 256), 1, 8)
    action = F.when(F.col("intact").isNotNull(), "reuse").when(F.coalesce("times", F.lit(0)) > 0, "recover").otherwise("publish")
    output = F.when(action == "reuse", F.col("intact")).when(action == "recover", F.concat("package_id", F.lit("-recuperado-"), digits)).otherwise(F.col("package_id"))
    return told.select("package_id", output.alias("output"), action.alias("action"))
