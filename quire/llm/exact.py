"""Grace hash deduplication: rows whose texts are equal without white space, found by comparing complete content.

Each task puts the texts it reads into an open-addressing table of at most TABLE_BYTES and writes what the table
held to a spill file in the shared folder: a record a row, of which only the first of each content carries the
content, with the number of its rows and the best of them. Records are dealt to buckets by a hash of the content;
a bucket whose contents fit TABLE_BYTES is put into one table, which compares complete content where hashes meet.
A bucket that doesn't fit is partitioned again: its records go through tables where they lie, so that copies of
one text from many tasks become one record, and what remains is dealt by a hash of another seed. Each level
writes which record took in which, and the verdicts go back along these, so no row of a group of copies is ever
gathered, only one record of it a table. A bucket that STUCK levels neither merge nor part is taken as it is: it
holds contents that alone are as large as a table.

Defined cases: null text is empty text, and all texts of white space only are equal. The row with the most code
points stays, then that with the smallest key (null the largest); of rows equal in both, one stays, whichever. An
empty table gives an empty result. Kept columns that clash with the result's names, whatever their case, are
replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256
from math import ceil

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .arrow import slices
from .shared import BLANKS, few, materialise, partitions

#: Bytes of content that a table holds; and the fill that the number of buckets aims at.
TABLE_BYTES = 32 << 20
FILL = 0.5
#: Records of a table, whatever their bytes; partitions of a shuffle at most (a task walks its buckets one by one).
TABLE_ROWS = 1 << 17
MOST_PARTITIONS = 50_000
#: Levels in a row that change nothing before what is left is taken as it is.
STUCK = 3
GONE = BLANKS.encode()
RECORD = "tab long, row int, grp int, h long, content binary, n_bytes long, size long, points long, best {key}, best_tab long, best_row int"


class Table:
    """An open-addressing table of contents: linear probing by hash, complete comparison where hashes are equal."""

    def __init__(self, room: int = 1 << 10):
        self.slots, self.hashes, self.contents, self.bytes = [-1] * room, [], [], 0

    def place(self, h: int, content: bytes) -> tuple[int, bool]:
        """The number of this content, and whether it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (n := self.slots[at]) >= 0:
            if self.hashes[n] == h and self.contents[n] == content:
                return n, False
            at = (at + 1) & mask
        n = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return n, True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for n, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = n


def better(a: tuple, b: tuple) -> bool:
    """Whether row a stays rather than b; both are (code points, key, ...)."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


class Spill:
    """One table's records in the order they came: what they weigh, and the group that each fell into."""

    def __init__(self, room: int):
        self.name, self.table, self.groups, self.room = uuid.uuid4().int >> 65, Table(), [], room
        self.sizes, self.best, self.first = [], [], []

    def add(self, h: int, content: bytes, size: int, best: tuple) -> None:
        """best: (code points, key, table, row) of the best row that the record stands for."""
        n, new = self.table.place(h, content)
        if new:
            self.sizes.append(size)
            self.best.append(best)
            self.first.append(len(self.groups))
        else:
            self.sizes[n] += size
            if better(best, self.best[n]):
                self.best[n] = best
        self.groups.append(n)

    def full(self) -> bool:
        return self.table.bytes >= self.room or len(self.groups) >= TABLE_ROWS

    def columns(self) -> list[list]:
        """By record: the table, its row, its group, and for a group's first record what the group weighs."""
        n = len(self.groups)
        held = [None] * n
        for g, at in enumerate(self.first):
            held[at] = g
        told = lambda values: [None if g is None else values[g] for g in held]
        return [
            [self.name] * n, list(range(n)), self.groups, told([_signed(h) for h in self.table.hashes]), told(self.table.contents), told([len(c) for c in self.table.contents]),
            told(self.sizes), *(told([b[k] for b in self.best]) for k in range(4)),
        ]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _fields(ddl: str, kind: str) -> tuple[StructType, pa.Schema]:
    fields = StructType.fromDDL(ddl.format(key=kind))
    return fields, to_arrow_schema(fields)


def spill(docs: DataFrame, text: str, key: str, keep: Sequence[str], room: int) -> DataFrame:
    """The first level: a record a row of docs, with the columns of keep (k0, k1, ...); written."""
    kind = docs.schema[key].dataType.simpleString()
    some = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    carried = [f"k{i}" for i in range(len(keep))]
    fields, schema = _fields(RECORD, kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = Spill(room), []

        def flush() -> pa.RecordBatch:
            new = [pa.array(c, t.type) for c, t in zip(now.columns(), schema, strict=True)]
            old = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0] if carried else None
            held.clear()
            return pa.RecordBatch.from_arrays([*new, *(old.columns if carried else [])], names=[*schema.names, *carried])

        for batch in batches:
            for part in slices(batch, "text"):
                begun = 0
                for i, (t, k) in enumerate(zip(part.column("text").to_pylist(), part.column("key").to_pylist(), strict=True)):
                    content = t.encode("utf-8", "surrogatepass").translate(None, GONE)
                    now.add(xxhash.xxh3_64_intdigest(content), content, 1, (len(t), k, now.name, len(now.groups)))
                    if now.full():
                        held.append(part.slice(begun, i + 1 - begun).select(carried))
                        yield flush()
                        now, begun = Spill(room), i + 1
                if begun < part.num_rows:
                    held.append(part.slice(begun).select(carried))
        if now.groups:
            yield flush()

    extra = [StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    return materialise(some.mapInArrow(run, StructType(fields.fields + extra)), "spill")


def _bucketed(records: DataFrame, seed: int, room: int) -> tuple[DataFrame, DataFrame, int]:
    """Records that hold a content with their bucket, the buckets that don't fit a table, and the number of partitions to deal to."""
    spark = records.sparkSession
    total = records.agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n")).first()
    n = max(partitions(spark), ceil((total["n_bytes"] or 0) / (room * FILL)), ceil(total["n"] / (TABLE_ROWS * FILL)))
    dealt = records.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(n)))
    large = dealt.groupBy("bucket").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n")).filter((F.col("n_bytes") > room) | (F.col("n") > TABLE_ROWS))
    return dealt, large.select("bucket"), min(n, max(partitions(spark), MOST_PARTITIONS))


def _through_tables(records: DataFrame, kind: str, room: int) -> DataFrame:
    """The next level of records where they lie: each with the table, the row and the group that it fell into."""
    fields, schema = _fields(RECORD + ", old_tab long, old_grp int", kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, olds = Spill(room), []

        def flush() -> pa.RecordBatch:
            columns = [*now.columns(), *zip(*olds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], names=schema.names)

        for batch in batches:
            for part in slices(batch, "content"):
                for r in zip(*(part.column(c).to_pylist() for c in ("tab", "grp", "h", "content", "size", "points", "best", "best_tab", "best_row")), strict=True):
                    now.add(r[2] % (1 << 64), r[3], r[4], r[5:])
                    olds.append(r[:2])
                    if now.full():
                        yield flush()
                        now, olds = Spill(room), []
        if olds:
            yield flush()

    return records.mapInArrow(run, fields)


def _resolve(dealt: DataFrame, parts: int, kind: str, room: int) -> DataFrame:
    """(tab, grp) of each record with its content's verdict; a task holds one bucket's table at a time."""
    fields, schema = _fields("tab long, grp int, keep {key}, keep_tab long, keep_row int, size long, sha string", kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, bucket = Spill(room), [], None

        def flush() -> pa.RecordBatch:
            digests = [sha256(c).hexdigest() for c in now.table.contents]
            rows = [(t, g, now.best[n][1], now.best[n][2], now.best[n][3], now.sizes[n], digests[n]) for (t, g), n in zip(members, now.groups, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)

        for batch in batches:
            for part in slices(batch, "content"):
                for r in zip(*(part.column(c).to_pylist() for c in ("bucket", "tab", "grp", "h", "content", "size", "points", "best", "best_tab", "best_row")), strict=True):
                    if r[0] != bucket and members:
                        yield flush()
                        now, members = Spill(room), []
                    bucket = r[0]
                    now.add(r[3] % (1 << 64), r[4], r[5], r[6:])
                    members.append(r[1:3])
        if members:
            yield flush()

    some = dealt.select("bucket", "tab", "grp", "h", "content", "size", "points", "best", "best_tab", "best_row")
    return some.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, fields)


def _verdicts(records: DataFrame, kind: str, room: int, seed: int = 0, before: int = -1, stuck: int = 0) -> DataFrame:
    """(tab, grp) and the verdict of every record that holds a content; buckets that don't fit go down a level."""
    dealt, large, parts = _bucketed(records, seed, room)
    large = materialise(large, "large")
    if not large.limit(1).count():
        return _resolve(dealt, parts, kind, room)
    marked = F.broadcast(large) if few(large) else large
    rest = dealt.join(marked, "bucket", "left_semi")
    held = rest.count()
    stuck = stuck + 1 if held == before else 0
    if stuck == STUCK:
        return _resolve(dealt, parts, kind, room)
    fits = _resolve(dealt.join(marked, "bucket", "left_anti"), parts, kind, room)
    level = materialise(_through_tables(rest, kind, room), "spill")
    below = _verdicts(level.filter("content IS NOT NULL").drop("old_tab", "old_grp"), kind, room, seed + 1, held, stuck)
    taken = level.select("tab", "grp", "old_tab", "old_grp").join(below, ["tab", "grp"]).drop("tab", "grp")
    return fits.unionByName(taken.withColumnsRenamed({"old_tab": "tab", "old_grp": "grp"}))


def find_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] = ("doc_id",), room: int = TABLE_BYTES) -> DataFrame:
    """Each row's columns of keep, keep_id (the key of the row that stays), group_size, kept and content_sha256; room: a table's bytes."""
    kind = docs.schema[key].dataType.simpleString()
    records = spill(docs, text, key, keep, room)
    found = _verdicts(records.filter("content IS NOT NULL"), kind, room)
    rows = records.select("tab", "row", "grp", *[f"k{i}" for i in range(len(keep))])
    told = rows.join(found, ["tab", "grp"])
    mine = {"keep_id", "group_size", "kept", "content_sha256"}
    return told.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c.lower() not in mine],
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("tab") == F.col("keep_tab")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("content_sha256"),
    )


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = find_copies(docs.toDF(*names.values()), names[text], names[key], list(names.values()))
    return found.filter("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
