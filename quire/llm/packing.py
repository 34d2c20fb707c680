"""Packing by minimum bin slack.

Documents (ids and an end mark) longer than a window give full windows of their own; what remains of each,
shorter than a window, is packed by length. Only the number of remainders of each length is needed for that,
at most WINDOW - 1 numbers whatever the size of the corpus. The plan is made from them: the longest length
left seeds a window, a bitset dynamic program over the other lengths (each as often as it is left) finds the
multiset that fills the window closest to its capacity, backtracking gives its counts, and the pattern is
repeated for as long as all its lengths last. Each pattern uses up a length, so the plan is bounded too.

Which remainder takes which place is settled by its rank among the remainders of its length. Ranks come from
counts by (length, salt), summed over the salts, and from a window within each (length, salt): copies that
share a length are spread over SALTS places.

A pattern that does not reach the capacity (at the end, as a rule) is cut at powers of two, as sequences of
such lengths need no padding; so no sequence is padded.

The ids are computed once and written to the shared folder with the checksums of the pieces; only remainders
that the plan cuts read their ids again.

Defined cases: null and empty texts are the end mark alone. Rows with the same doc_id are packed each.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordtok
from .arrow import texts, with_columns
from .shared import materialise, small

WINDOW = 4096
END_ID = 2
#: Places over which the remainders of one length, and the long documents, are spread to be ranked; the same at every size.
SALTS = 256


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (each at most as often as counted) whose sum comes closest to capacity from below.

    Lengths are tried from the longest; bit s of `reach` says that a sum of s can be made. Steps that have a
    length several times are split into powers of two, and the steps are walked back for the counts.
    """
    reach, full = 1, 1 << capacity
    steps: list[tuple[int, int, int]] = []  # length, times, reach before
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, times = min(counts[length], capacity // length), 1
        while left and not reach & full:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << length * times) & (2 * full - 1)
            left -= times
            times *= 2
        if reach & full:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> best & 1:
            best -= length * times
            chosen[length] = chosen.get(length, 0) + times
    return chosen


def powers(total: int, window: int = WINDOW) -> list[int]:
    """total as falling powers of two up to window, each a sequence without padding."""
    return [window] * (total // window) + [1 << b for b in range(window.bit_length() - 2, -1, -1) if total % window >> b & 1]


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(repeats, length -> times) patterns that use up counts."""
    left, patterns = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        rest = fill({k: v for k, v in left.items() if v}, window - seed)
        left[seed] += 1
        pattern = dict(rest)
        pattern[seed] = pattern.get(seed, 0) + 1
        repeats = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
        patterns.append((repeats, pattern))
    return patterns


class Places:
    """The plan by length: for a remainder's rank its sequence and offset, and where it is cut."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]], window: int = WINDOW):
        rows: dict[int, list[tuple[int, int, int, int, tuple[int, ...]]]] = {}
        used: dict[int, int] = {}
        self.sequences = 0
        for repeats, pattern in patterns:
            parts = powers(sum(k * n for k, n in pattern.items()), window)
            edges, offset = tuple(np.cumsum([0, *parts]).tolist()), 0
            for length in sorted(pattern, reverse=True):
                times = pattern[length]
                rows.setdefault(length, []).append((used.get(length, 0), times, self.sequences, offset, edges))
                used[length] = used.get(length, 0) + times * repeats
                offset += length * times
            self.sequences += repeats * len(parts)
        self.rows = rows
        self.firsts = {k: np.array([r[0] for r in v]) for k, v in rows.items()}

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the remainder, length, sequence, offset) of each piece."""
        first, times, base, offset, edges = self.rows[length][int(np.searchsorted(self.firsts[length], rank, side="right")) - 1]
        repeat, slot = divmod(rank - first, times)
        begin, base = offset + slot * length, base + repeat * (len(edges) - 1)
        end, out = begin + length, []
        for k in range(len(edges) - 1):
            a, b = max(begin, edges[k]), min(end, edges[k + 1])
            if a < b:
                out.append((a - begin, b - a, base + k, a - edges[k]))
        return out


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """row, doc_id, doc_tokens, whole (checksums of full windows), rest_crc and ids of each document, in the shared folder."""
    path = path or wordtok.default_path()
    mark = np.uint32(END_ID).tobytes()

    def make():
        own = wordtok.tokenizer(path)

        def work(part: pa.RecordBatch):
            ids = [x + mark for x in own.encode_batch(texts(part, text))]
            size = 4 * window
            whole = [[crc32(x[k : k + size]) for k in range(0, len(x) - size + 1, size)] for x in ids]
            rest = [crc32(x[len(x) - len(x) % size :]) for x in ids]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(rest, pa.int64()), pa.array(ids, pa.binary())]

        return work

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias(text))
    return materialise(with_columns(own, "doc_tokens bigint, whole array<bigint>, rest_crc bigint, ids binary", make, by=text, drop=[text], done=lambda: wordtok.tokenizer(path).rest()), "tokens")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = tokenise(docs, key, text, path, window)
    spark = docs.sparkSession
    rest = (F.col("doc_tokens") % window).cast("int")
    narrow = tokens.select("row", "doc_id", "doc_tokens", "rest_crc", rest.alias("rest"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")).filter("rest > 0")
    counts = materialise(narrow.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    lengths = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most window - 1 rows
    places = Places(plan(lengths, window), window)
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("rest", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("rest", "salt").orderBy("row"))
    ranked = narrow.withColumn("nth", within - 1).join(starts, ["rest", "salt"]).select("row", "doc_id", "doc_tokens", "rest_crc", "rest", (F.col("first") + F.col("nth")).alias("rank"))

    shared = spark.sparkContext.broadcast(places)

    def make():
        own = shared.value

        def work(part: pa.RecordBatch):
            found = [own.pieces(n, r) for n, r in zip(part.column("rest").to_pylist(), part.column("rank").to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]))
            return [pa.array([[dict(zip(("begin", "length", "sequence_id", "offset"), p, strict=True)) for p in ps] for ps in found], kind)]

        return work

    by_rank = ranked.withColumn("_tag", F.lit("12345678"))
    laid = with_columns(by_rank, "pieces array<struct<begin:bigint,length:bigint,sequence_id:bigint,offset:bigint>>", make, by="_tag", drop=["_tag"])
    laid = laid.select("row", "doc_id", "doc_tokens", "rest_crc", "rest", F.explode("pieces").alias("p")).select(
        "row", "doc_id", (F.col("doc_tokens") - F.col("rest") + F.col("p.begin")).alias("start"), F.col("p.length").alias("length"),
        F.when(F.col("p.length") == F.col("rest"), F.col("rest_crc")).alias("ids_crc32"), "doc_tokens", F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"),
    )
    laid = materialise(laid, "pieces")
    cut = tokens.select("row", "ids").join(small(laid.filter("ids_crc32 IS NULL").drop("ids_crc32")), "row")

    def checksums():
        def work(part: pa.RecordBatch):
            rows = zip(part.column("ids").to_pylist(), part.column("start").to_pylist(), part.column("length").to_pylist(), strict=True)
            return [pa.array([crc32(x[4 * a : 4 * (a + n)]) for x, a, n in rows], pa.int64())]

        return work

    cut = with_columns(cut, "ids_crc32 bigint", checksums, by="ids", drop=["ids"])
    return laid.filter("ids_crc32 IS NOT NULL").unionByName(cut).drop("row").unionByName(_whole(tokens, places.sequences, window))


def _whole(tokens: DataFrame, first: int, window: int) -> DataFrame:
    """The full windows of long documents, numbered from first on."""
    long = tokens.select("row", "doc_id", "doc_tokens", "whole", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")).filter(F.size("whole") > 0)
    n = F.size("whole").cast("long")
    # SALTS rows at most: their running sum is one small window.
    totals = long.groupBy("salt").agg(F.sum(n).alias("n"))
    sums = totals.select("salt", (F.sum("n").over(Window.orderBy("salt")) - F.col("n")).alias("first"))
    within = F.sum(n).over(Window.partitionBy("salt").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    placed = long.withColumn("nth", F.coalesce(within, F.lit(0))).join(F.broadcast(sums), "salt")
    return placed.select("doc_id", "doc_tokens", (F.col("first") + F.col("nth") + first).alias("base"), F.posexplode("whole").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
