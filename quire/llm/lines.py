"""Reversible line dedup: exact reference counts, sharded cuckoo filters in front of them.

A line's key is the line without white space at both ends, A-Z lower-cased; keys are held as their MD5. The
index of a corpus has two tables in the shared folder: `counts` (shard, key, n_docs), the exact number of
documents that hold each key, and `filters` (shard, a cuckoo filter), which holds the keys that have reached
the threshold. Inserting documents adds their keys to the counts, deleting documents takes them off again;
keys that cross the threshold either way are put into or taken out of their shard's filter, so every index is
the one that its documents alone would have built.

Cleaning documents asks the filters about the key of every line, where the lines are: the filters, about two
bytes a repeated key, are sent to all tasks while they take at most FILTER_BYTES, so that only lines that may go
are moved at all. A filter never misses a key it holds; its hits are looked up in the exact counts, by a broadcast
of up to BROADCAST_ROWS keys and beyond that by a join that spreads each key over SALTS places. Filters of more
than FILTER_BYTES stay in their shards, and the distinct keys are sent to them. What comes back are the places of
the lines to drop, so a document's lines are cut out in one pass, however many they are.

Shards are chosen by the key's hash, about SHARD_KEYS repeated keys each: their number doubles as the index
grows. Keys are reduced to one row before they are dealt to shards, so a line that a third of all documents hold
is one row there.

Defined cases: null and empty texts are one empty line. Keys of no code points never count. A key counts once
a document, however often it holds it; rows with the same doc_id (null too) are one document. Rows are kept
one for one and clashing columns replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import raw
from .shared import BLANKS, ascii_lower, few, fresh, let, materialise, scratch_path

THRESHOLD = 10
SHARD_KEYS = 200_000
SALTS = 32
#: Bytes of filters that are sent to every task; larger ones stay in their shards.
FILTER_BYTES = 32 << 20
SLOTS, KICKS = 4, 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports deletion, and doubles when it is full."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def _prints(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and 32-bit place of each 16-byte key."""
        parts = keys.view(np.uint32).reshape(-1, 4)
        return (parts[:, 1] % np.uint32(65535) + np.uint32(1)).astype(np.uint16), parts[:, 0]

    def _other(self, place: int, print_: int) -> int:
        return (place ^ (print_ * 0x5BD1E995)) & (len(self.table) - 1)

    def _put(self, place: int, print_: int) -> bool:
        place &= len(self.table) - 1
        for at in (place, self._other(place, print_)):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = print_
                return True
        for k in range(KICKS):
            slot = (print_ + k) % SLOTS
            print_, self.table[at, slot] = int(self.table[at, slot]), print_
            at = self._other(at, print_)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = print_
                return True
        return False

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all keys found room; if not, the filter is spoilt and must be built anew, larger."""
        prints, places = self._prints(keys)
        return all(self._put(p, f) for f, p in zip(prints.tolist(), places.tolist(), strict=True))

    def delete(self, keys: np.ndarray) -> None:
        prints, places = self._prints(keys)
        for f, p in zip(prints.tolist(), places.tolist(), strict=True):
            p &= len(self.table) - 1
            for at in (p, self._other(p, f)):
                held = np.flatnonzero(self.table[at] == f)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, places = self._prints(keys)
        mask = len(self.table) - 1
        one = places.astype(np.int64) & mask
        two = (one ^ (prints.astype(np.int64) * 0x5BD1E995)) & mask
        f = prints[:, None]
        return (self.table[one] == f).any(axis=1) | (self.table[two] == f).any(axis=1)

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 64
        while buckets * SLOTS * 0.85 < len(keys):
            buckets *= 2
        while True:
            found = cls(buckets)
            if found.insert(keys):
                return found
            buckets *= 2

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def _keys(values: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 16).copy()


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def document_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, hash (of the whole text), pos and key (MD5) of each line that has a key."""
    of = lambda line: F.when(line_key(line) != "", F.md5(F.encode(line_key(line), "utf-8")))
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    told = own.select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(F.transform(split_lines(F.col("text")), of)).alias("pos", "key"))
    return told.filter("key IS NOT NULL").withColumn("key", F.unhex("key"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class LineIndex:
    """Where an index's tables are: counts, filters."""

    folder: str
    shards: int
    threshold: int

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("shard int, key binary, n_docs bigint").parquet(f"{self.folder}/counts")

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("shard int, filter binary, n_keys bigint").parquet(f"{self.folder}/filters")


def empty_index(spark: SparkSession, shards: int = 16, threshold: int = THRESHOLD) -> LineIndex:
    index = LineIndex(scratch_path(spark, "lines"), shards, threshold)
    spark.createDataFrame([], "shard int, key binary, n_docs bigint").write.parquet(f"{index.folder}/counts")
    spark.createDataFrame([], "shard int, filter binary, n_keys bigint").write.parquet(f"{index.folder}/filters")
    return index


def shards_for(keys: int, least: int) -> int:
    """least, doubled until a shard has about SHARD_KEYS of the keys at most."""
    while least * SHARD_KEYS < keys:
        least *= 2
    return least


def _update(index: LineIndex, changes: DataFrame) -> LineIndex:
    """A new index: the counts with changes (key, change) added, the filters with the keys that crossed the threshold."""
    spark, t = changes.sparkSession, index.threshold
    was = index.counts(spark).select("key", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("change"))
    both = was.unionByName(changes.select("key", F.lit(0).cast("long").alias("was"), F.col("change").cast("long").alias("change")))
    both = both.groupBy("key").agg(F.sum("was").alias("was"), F.sum(F.col("was") + F.col("change")).alias("n_docs"))
    # Documents without repeated lines make most keys: their rows stay in the counts, but only crossings meet a filter.
    staged = materialise(both.filter((F.col("n_docs") != 0) | (F.col("was") != 0)), "line-counts")
    now = staged.filter(F.col("n_docs") >= t).select("key")
    new = LineIndex(scratch_path(spark, "lines"), shards_for(now.count(), index.shards), t)
    shard = shard_of(new.shards).alias("shard")
    staged.filter("n_docs > 0").select(shard, "key", "n_docs").write.option("compression", "zstd").parquet(f"{new.folder}/counts")
    none = F.lit(None).cast("boolean").alias("up")
    dealt = now.select(shard, F.lit(2).alias("part"), F.col("key").alias("value"), none)
    if new.shards == index.shards:  # else every filter is built anew
        crossed = staged.filter((F.col("was") >= t) != (F.col("n_docs") >= t))
        dealt = dealt.unionByName(crossed.select(shard, F.lit(1).alias("part"), F.col("key").alias("value"), (F.col("n_docs") >= t).alias("up")))
        dealt = dealt.unionByName(index.filters(spark).select("shard", F.lit(0).alias("part"), F.col("filter").alias("value"), none))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("n_keys", pa.int64())])
        for shard, rows in _shards(batches):
            kept = [v for p, v, _ in rows if p == 2]
            stored = [v for p, v, _ in rows if p == 0]
            own = CuckooFilter.load(stored[0]) if stored else None
            ok = own is not None
            if own is not None:
                own.delete(_keys(v for p, v, up in rows if p == 1 and not up))
                ok = own.insert(_keys(v for p, v, up in rows if p == 1 and up))
            if not ok:
                own = CuckooFilter.build(_keys(kept))
            if kept:
                yield pa.RecordBatch.from_pylist([{"shard": shard, "filter": own.dump(), "n_keys": len(kept)}], schema)

    dealt = dealt.repartition(new.shards, "shard").sortWithinPartitions("shard", "part", "value")
    dealt.mapInArrow(run, "shard int, filter binary, n_keys bigint").write.parquet(f"{new.folder}/filters")
    return new


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes, bool | None]]]]:
    now, held = None, []
    for batch in batches:
        for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "value", "up")), strict=True):
            if s != now:
                if held:
                    yield now, held
                now, held = s, []
            held.append(tuple(row))
    if held:
        yield now, held


def insert_documents(index: LineIndex, pairs: DataFrame) -> LineIndex:
    """The index with these (doc_id, key) pairs' documents in it; they must not be in it yet."""
    return _update(index, pairs.dropDuplicates(["doc_id", "key"]).groupBy("key").agg(F.count(F.lit(1)).alias("change")))


def delete_documents(index: LineIndex, pairs: DataFrame) -> LineIndex:
    """The index without these documents; they must be in it."""
    return _update(index, pairs.dropDuplicates(["doc_id", "key"]).groupBy("key").agg((-F.count(F.lit(1))).alias("change")))


def _shipped(index: LineIndex, pairs: DataFrame) -> DataFrame | None:
    """The pairs that the filters let through, asked where the pairs are; None if the filters are too large for that."""
    spark = pairs.sparkSession
    stored = index.filters(spark)
    size = stored.agg(F.sum(F.octet_length("filter")).alias("bytes")).first()["bytes"] or 0
    if size > FILTER_BYTES:
        return None
    shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in stored.collect()})  # at most FILTER_BYTES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.load(v) for k, v in shared.value.items()}
        for batch in batches:
            shards = np.asarray(batch.column("shard"))
            keys, hit = raw(batch.column("key"))[0].reshape(-1, 16), np.zeros(len(shards), bool)
            for k, own in filters.items():
                rows = np.flatnonzero(shards == k)
                hit[rows] = own.contains(np.ascontiguousarray(keys[rows]))
            if hit.any():
                yield batch.filter(pa.array(hit)).drop_columns("shard")

    return pairs.withColumn("shard", shard_of(index.shards)).mapInArrow(run, pairs.schema)


def _hits_by_shard(index: LineIndex, pairs: DataFrame) -> DataFrame:
    """The pairs' distinct keys that the filters let through, asked in the filters' shards."""
    spark = pairs.sparkSession
    asked = pairs.select("key").distinct().select(shard_of(index.shards).alias("shard"), F.lit(1).alias("part"), F.col("key").alias("value"))
    stored = index.filters(spark).select("shard", F.lit(0).alias("part"), F.col("filter").alias("value"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            hits, waiting = [], []
            for s, p, v in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "value")), strict=True):
                if s != now:
                    hits += _hits(own, waiting)
                    now, own, waiting = s, None, []
                if p == 0:
                    own = CuckooFilter.load(v)
                else:
                    waiting.append(v)
            hits += _hits(own, waiting)
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.binary())], names=["key"])

    return stored.unionByName(asked).repartition(index.shards, "shard").sortWithinPartitions("shard", "part").mapInArrow(run, "key binary")


def _hits(own: CuckooFilter | None, values: list[bytes]) -> list[bytes]:
    if own is None or not values:
        return []
    return [v for v, hit in zip(values, own.contains(_keys(values)).tolist(), strict=True) if hit]


def dropped_lines(index: LineIndex, pairs: DataFrame) -> DataFrame:
    """The pairs whose keys are at or over the threshold: hits of the filters, looked up in the exact counts."""
    exact = index.counts(pairs.sparkSession).filter(F.col("n_docs") >= index.threshold).select("key")
    found = _shipped(index, pairs)
    if found is None:
        found, exact = pairs, materialise(exact.join(_hits_by_shard(index, pairs), "key", "left_semi"), "dropped-keys")
    if few(exact):
        return found.join(F.broadcast(exact), "key")
    spread = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "hash", "pos"), F.lit(SALTS)).cast("int")).join(spread, ["key", "salt"]).drop("salt")


def dropped_keys(index: LineIndex, pairs: DataFrame) -> DataFrame:
    return dropped_lines(index, pairs).select("key").distinct()


def without_lines(text: Column, gone: Column) -> Column:
    """text without its lines at the places of gone (rising): the runs between them, in one pass."""

    def of(lines: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines)))
        runs = F.transform(starts, lambda s, i: F.slice(lines, s + 2, F.get(ends, i) - s - 1))
        return F.array_join(F.flatten(runs), "\n")

    return let(split_lines(text), of)


def drop_lines(docs: DataFrame, index: LineIndex, pairs: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text cleaned, n_lines (before) and n_dropped."""
    pairs = document_keys(docs, key, text) if pairs is None else pairs
    doc, hash_, gone = fresh(docs, "doc", "hash", "gone")
    bad = dropped_lines(index, pairs).groupBy(F.col("doc_id").alias(doc), F.col("hash").alias(hash_)).agg(F.sort_array(F.collect_set("pos")).alias(gone))
    stay = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (text.lower(), "n_lines", "n_dropped")]
    whole = F.col(f"`{text}`")
    joined = docs.join(bad, F.col(f"`{key}`").eqNullSafe(F.col(doc)) & (F.xxhash64(whole) == F.col(hash_)), "left")
    cleaned = F.when(F.col(gone).isNull(), F.coalesce(whole, F.lit(""))).otherwise(without_lines(whole, F.col(gone)))
    return joined.select(*stay, cleaned.alias(text), F.size(split_lines(whole)).cast("long").alias("n_lines"), F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs without the lines whose keys are in at least threshold documents of docs."""
    pairs = materialise(document_keys(docs, key, text), "line-keys")
    index = insert_documents(empty_index(docs.sparkSession, threshold=threshold), pairs)
    return drop_lines(docs, index, pairs, key, text)
