"""Filter interaction audit: what each filter of a pipeline removes in every order, by part of the corpus.

Every document gets a mask, a bit a filter that it fails. The filters that look at the text alone are worked out
where the text is read. The filter COPIES (fails a text that a row of smaller key has too) is found by fingerprints:
the rows go as an RDD to the partition of their text's xxhash; there a chain of each hash holds full texts with
their minimum key, and rows of a larger key are emitted as copies. A task first keeps such chains of what it reads,
up to CHAIN_BYTES, so that a text goes on once a chain, however many copies a task has; rows that are copies already
go on without text, dealt by a number. Partitions are sorted by hash, so that a task holds one chain at a time.

The masks are then merged to count vectors by combineByKey, a vector a part: documents, good and toxic ones of each
of the 2^k masks. All orders of the filters are worked out from a part's vector alone.

Defined cases: null text is empty text; null part is the empty string. A row whose key is null is never a copy nor
makes one; repeated rows of one key are not copies of each other. A label's row counts for every row of its key;
repeated labels of a key count as one that holds if any does. An empty table has no part and gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import count, permutations
from math import ceil

import numpy as np
import xxhash
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few, materialise, partitions

#: Bytes of text that a task's chains hold before they go on; and what a partition of the routed rows aims at.
CHAIN_BYTES = 16 << 20
PART_BYTES = 32 << 20
MOST_PARTITIONS = 50_000
#: Tasks begin this far apart when they deal rows by a running number.
SPREAD = 7919
COPIES = "copies"
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The filters of the audit: whether a text fails, given its UTF-8 bytes, its words and its code points.
FILTERS: Mapping[str, Callable[[bytes, list[bytes], int], bool] | str] = {
    "A": lambda data, words, points: len(words) < 50,
    "B": lambda data, words, points: 100 * len(set(words)) < 65 * len(words),
    "C": lambda data, words, points: 100 * (len(data) - len(data.translate(None, CAPITALS))) > 5 * points,
    "D": lambda data, words, points: SIGNS.search(data) is not None,
    "E": COPIES,
}

#: A row on its way: its key, its part, its mask, how many such rows.
Told = tuple[object, str, int, int]


class Chain:
    """Full texts of one or more hashes, each with its minimum key, its mask and its rows of that key by part."""

    def __init__(self, bit: int):
        self.bit, self.held, self.bytes = bit, {}, 0

    def add(self, h: int, data: bytes, key: object, mask: int, parts: dict[str, int]) -> Iterator[Told]:
        """Take rows of one text and key; what turns out to be a copy is emitted."""
        chain = self.held.setdefault(h, [])
        for link in chain:
            if link[0] == data:
                break
        else:
            chain.append([data, key, mask, dict(parts)])
            self.bytes += len(data) + 100
            return
        if key > link[1]:
            yield from ((key, p, mask | self.bit, n) for p, n in parts.items())
        elif key < link[1]:
            yield from ((link[1], p, mask | self.bit, n) for p, n in link[3].items())
            link[1], link[3] = key, dict(parts)
        else:
            for p, n in parts.items():
                link[3][p] = link[3].get(p, 0) + n


def masks(docs: DataFrame, filters: Mapping = FILTERS, text: str = "text", key: str = "doc_id", part: str = "source", room: int = CHAIN_BYTES) -> DataFrame:
    """(key, part, mask, n): how many rows of a key and part fail which filters, bit i the i-th; room: bytes of a task's chains; written."""
    spark = docs.sparkSession
    some = docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    tests = [(1 << i, f) for i, f in enumerate(filters.values()) if f is not COPIES]
    bit = sum(1 << i for i, f in enumerate(filters.values()) if f is COPIES)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    n = min(max(partitions(spark), ceil(size / PART_BYTES)), MOST_PARTITIONS)

    def read(rows: Iterable[tuple]) -> Iterator[tuple[int, tuple]]:
        """Rows that are settled under a running number and 0, texts under their hash and 1."""
        chains, turn = Chain(bit), count(SPREAD * TaskContext.get().partitionId())
        settled = lambda told: ((next(turn), 0), told)
        for k, p, t in rows:
            data = t.encode("utf-8", "surrogatepass")
            words, points = data.split(), len(t)
            mask = sum(b for b, fails in tests if fails(data, words, points))
            if k is None or not bit:
                yield settled((k, p, mask, 1))
                continue
            for told in chains.add(xxhash.xxh3_64_intdigest(data), data, k, mask, {p: 1}):
                yield settled(told)
            if chains.bytes >= room:
                yield from go_on(chains)
                chains = Chain(bit)
        yield from go_on(chains)

    def go_on(chains: Chain) -> Iterator[tuple[tuple, tuple]]:
        for h, chain in chains.held.items():
            for link in chain:
                yield (h, 1), tuple(link)

    def meet(rows: Iterable[tuple[tuple, tuple]]) -> Iterator[Told]:
        chains, at = Chain(bit), None
        for (h, kind), told in rows:
            if not kind:
                yield told
                continue
            if h != at:
                yield from left(chains)
                chains, at = Chain(bit), h
            data, k, mask, parts = told
            yield from chains.add(h, data, k, mask, parts)
        yield from left(chains)

    def left(chains: Chain) -> Iterator[Told]:
        for chain in chains.held.values():
            for _, k, mask, parts in chain:
                yield from ((k, p, mask, c) for p, c in parts.items())

    routed: RDD = some.rdd.mapPartitions(read).repartitionAndSortWithinPartitions(n, lambda k: k[0])
    kind = docs.schema[key].dataType.simpleString()
    return materialise(spark.createDataFrame(routed.mapPartitions(meet), f"key {kind}, part string, mask int, n long", verifySchema=False), "masks")


def vectors(told: DataFrame, labels: DataFrame, k: int) -> RDD:
    """(part, counts[2^k, 3]): documents, good and toxic ones by mask."""
    marks = labels.groupBy("key").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = F.broadcast(marks) if few(marks) else marks
    each = told.groupBy("key", "part", "mask").agg(F.sum("n").alias("n")).join(marks, "key", "left")
    rows = each.select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def merge(v: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        v[mask] += (n, n * good, n * toxic)
        return v

    return rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: merge(np.zeros((1 << k, 3), np.int64), row), merge, lambda a, b: a + b)


def orders(counts: np.ndarray, names: list[str]) -> Iterator[tuple]:
    """A row an order and step of one part's counts."""
    k = len(names)
    fails = np.array([[mask >> f & 1 for mask in range(1 << k)] for f in range(k)], bool)
    alone = [int(counts[1 << f, 0]) for f in range(k)]
    rows, removed_by = [], [0] * k
    for order in permutations(range(k)):
        left, kept = np.ones(1 << k, bool), int(counts[:, 0].sum())
        for step, f in enumerate(order):
            here, late = counts[left & fails[f]].sum(axis=0), int(counts[~left & fails[f], 0].sum())
            left &= ~fails[f]
            kept -= int(here[0])
            removed_by[f] += int(here[0])
            rows.append(("".join(names[g] for g in order), step + 1, f, kept, int(here[0]), late, alone[f], int(here[1]), int(here[2])))
    for order, step, f, *told in rows:
        yield (order, step, *told, removed_by[f])


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping = FILTERS, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """A row a part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    labels has the key, quality and toxic; filters are named by one letter each.
    """
    names = list(filters)
    told = masks(docs, filters, text, key, part)
    marks = labels.select(F.col(f"`{key}`").alias("key"), "quality", "toxic")
    found = vectors(told, marks, len(names)).flatMap(lambda x: ((x[0], *row) for row in orders(x[1], names)))
    return docs.sparkSession.createDataFrame(
        found, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long", verifySchema=False
    )
