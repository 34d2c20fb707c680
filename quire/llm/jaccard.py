"""N-gram Jaccard join by a token-group matrix.

Documents link when their sets of five-word shingles have a Jaccard similarity of at least PERCENT; the result
is every document's component. The steps:

1. One pass makes each text's set (64-bit shingles), its digest, two min-hashes, and counts of shingles in a
   sketch of fixed size. Documents with equal sets become one (the smallest doc_id stands for them).
2. Similar documents are partitioned into groups: those that share a min-hash with the most copied document
   that has it, and are at least SIMILAR percent like it by an exact comparison. All others are groups of one.
3. The token-group matrix has a row for each token in the union of a group's prefixes. A document's prefix is
   the part of its set, rarest tokens first by the sketch, in which any linked document must meet it: the
   first n - ceil(0.8 n) + 1 tokens; for the smaller document of a pair, the index part, about three quarters
   of them, will do. Any order would do for right results; rare tokens first keep common passages out of the
   prefixes. The tokens of a group are combined to one row before they are dealt out, however large it is.
4. Groups that meet are candidates if the bound on their overlap allows a link: by sizes and by the tokens'
   places, and by the number of tokens in which they meet. A token that more than HOT groups hold is set aside and
   its groups are compared block by block, in as many tasks as that takes. First the groups' own documents are
   compared. Groups whose members are not all linked with each other by then are opened: the members of the smaller
   one are asked of the larger one's, and within a group its members outside its largest component are asked of all
   members. Of these only such are compared as have enough tokens of their prefixes in common with the other side
   (see worth_asking; one row a token and document, no pairs), in blocks of about BLOCK_TOKENS tokens. Comparisons are
   exact, on whole texts.
5. The links' components are the result.

No pairs within a group are made, and no link between different groups is lost: two groups with a linked pair
meet in enough tokens of both prefixes, and stay candidates until they are in one component or every member of
the one has been compared with every member of the other.

Defined cases: texts without words, null and empty ones have no shingles, link with nothing, and are their own
component. Rows that share a doc_id are one document with all their texts. A null doc_id is linked with
nothing and has a null component. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import raw, slices, with_columns
from .components import components
from .shared import few, materialise, small
from .shingles import likeness, mix, shingle_sets

PERCENT, SIMILAR = 80, 50
#: Counters of the sketch, and the blocks in which its parts are summed.
SKETCH_BITS, BLOCKS = 18, 64
#: Tokens of a block of an opened group, and documents asked of a block by one task.
BLOCK_TOKENS, ASKED = 200_000, 1_000
#: Groups of one token that a task compares; of more, this many are a block.
HOT = 16_384
#: Pairs that a task holds before it counts them and hands them on.
HELD_PAIRS = 500_000
PROFILE = "doc_id bigint, n int, digest binary, near array<bigint>, block int, counters binary"
#: sizes: least and greatest set (32 bits each); places: least and greatest place of the token, and whether in an index part.
ENTRIES = "token bigint, unit bigint, sizes bigint, places bigint"


def probed(n):
    """Tokens of the prefix of a set of n, for numbers and arrays."""
    return n - -(-4 * n // 5) + 1


def index_part(n):
    """Tokens of the prefix that will do for the smaller set of a pair: at least n - ceil(8 n / 9) + 1."""
    return (probed(n) + n - -(-8 * n // 9) + 1) // 2


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def min_hashes(s: np.ndarray) -> list[int]:
    return [int(signed(mix(s + np.uint64(salt)).min(keepdims=True))[0]) for salt in (0x1F83D9AB, 0x5BE0CD19)]


def profile(docs: DataFrame) -> DataFrame:
    """PROFILE rows: one a document, and BLOCKS rows a task with its part of the sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("near", pa.list_(pa.int64())), ("block", pa.int32()), ("counters", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*raw(part.column("text")))
                if tokens := [s for s in sets if len(s)]:
                    sketch += np.bincount((np.concatenate(tokens) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint64)
                rows = [
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([min_hashes(s) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(rows, schema=schema)
        if sketch.any():
            parts = [x.tobytes() for x in np.split(sketch, BLOCKS)]
            none = [pa.nulls(BLOCKS, f.type) for f in list(schema)[:4]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PROFILE)


def sketch_of(profiled: DataFrame) -> np.ndarray:
    """The summed sketch: each block is summed as its parts stream by, and BLOCKS rows of fixed size come here."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("counters"), strict=True):
                x = np.frombuffer(part.as_buffer(), np.uint64)
                sums[block] = sums[block] + x if block in sums else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counters"])

    parts = profiled.filter("block IS NOT NULL").select("block", "counters").repartition("block").mapInArrow(run, "block int, counters binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    size = len(out) // BLOCKS
    for r in parts.collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counters"], np.uint64)
    shift = max(0, int(out.max()).bit_length() - 24)
    return out >> np.uint64(shift)


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids that are at least SIMILAR, with their likeness in percent. A hot a is split by the adaptive join."""
    pairs = materialise(pairs.distinct(), "pairs")
    right = docs.join(small(pairs.withColumnRenamed("b", "doc_id")), "doc_id").select("a", F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = docs.join(small(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id").select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = right.join(left.hint("merge"), "a")

    def make():
        last: list = [None, None]

        def work(part: pa.RecordBatch):
            out, sets = [], shingle_sets(*raw(part.column("text_b")))
            for k, (s, text) in enumerate(zip(sets, part.column("text_a"), strict=True)):
                text = text.as_py()
                if last[0] != text:
                    last[:] = [text, shingle_sets(*raw(part.column("text_a").slice(k, 1)))[0]]
                out.append(likeness(last[1], s))
            return [pa.array(out, pa.int32())]

        return work

    found = with_columns(both, "likeness int", make, by="text_b", drop=["text_a", "text_b"]).filter(F.col("likeness") >= SIMILAR)
    return found.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def pack(low, high, near, far, indexed):
    """sizes and places of ENTRIES, of arrays or columns."""
    return low * (1 << 32) + high, near * (1 << 33) + far * 2 + indexed


def unpack(sizes, places):
    """low, high, near, far and indexed (0 or 1) of arrays."""
    return sizes >> 32, sizes & 0xFFFFFFFF, places >> 33, (places >> 1) & 0xFFFFFFFF, places & 1


def combined(members: DataFrame) -> DataFrame:
    """ENTRIES of members' documents, one row for each token of each group."""
    low, high = F.shiftright("sizes", 32), F.col("sizes").bitwiseAND(F.lit(0xFFFFFFFF))
    near, far = F.shiftright("places", 33), F.shiftright("places", 1).bitwiseAND(F.lit(0xFFFFFFFF))
    indexed = F.col("places").bitwiseAND(F.lit(1))
    found = members.groupBy("token", "unit").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.min(near).alias("near"), F.max(far).alias("far"), F.max(indexed).alias("indexed"))
    sizes, places = pack(*(F.col(c) for c in ("low", "high", "near", "far", "indexed")))
    return found.select("token", "unit", sizes.alias("sizes"), places.alias("places"))


def entries(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """ENTRIES of the documents' prefixes; docs has doc_id, text and unit (its group)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    schema = pa.schema([(c, pa.int64()) for c in ("token", "unit", "sizes", "places")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*raw(part.column("text")))
                tokens, sizes, lengths = [], [], []
                for s in sets:
                    n = len(s)
                    prefix = probed(n) if n else 0
                    order = (counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(40)) | (s >> np.uint64(24))
                    first = np.argpartition(order, prefix - 1)[:prefix] if prefix < n else np.arange(n)
                    first = np.sort(first)  # by token, which settles ties of the order
                    tokens.append(s[first[np.argsort(order[first], kind="stable")]])
                    sizes.append(n)
                    lengths.append(prefix)
                sizes, lengths = np.array(sizes, np.int64), np.array(lengths, np.int64)
                n = np.repeat(sizes, lengths)
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                unit = np.repeat(np.asarray(part.column("unit")), lengths)
                if len(n):
                    packed = pack(n, n, place, place, place < index_part(n))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(unit), *map(pa.array, packed)], schema=schema)

    return docs.select("doc_id", "text", "unit").mapInArrow(run, ENTRIES)


def _meetings(x: np.ndarray, y: np.ndarray, both: bool, unit: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray, indexed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of x and y, units of one token, whose overlap may suffice, as two arrays at a time; both: x and y are the same, and each pair comes once."""
    fits = lambda a, b: (5 * high[a] >= 4 * low[b]) & (low[a] <= high[b]) & (indexed[a] > 0)  # noqa: E731  a, the smaller, may be linked with b
    step, y = max(1, 1_000_000 // max(len(y), 1)), y[None, :]
    for k in range(0, len(x), step):
        some = x[k : k + step][:, None]
        # Tokens before this one in both, and what is left of either, against the least overlap of the smallest.
        most = np.minimum(far[some], far[y]) + np.minimum(high[some] - near[some], (high - near)[y])
        least = 4 * (low[some] + low[y])
        i, j = np.nonzero((unit[some] < unit[y] if both else unit[some] != unit[y]) & (fits(some, y) | fits(y, some)) & (9 * most >= least))
        yield some[i, 0], y[0, j]


MET = "a bigint, b bigint, times bigint, low_a bigint, high_a bigint, low_b bigint, high_b bigint, token bigint, unit bigint, sizes bigint, places bigint"


def _met(dealt: DataFrame, hot: float) -> DataFrame:
    """MET rows of rows (token, side, unit, sizes, places) in order of token: the pairs of units of each token, with how often they met, and rows of tokens that more than hot units hold.

    Rows of side 0 meet each other if the token has no others; else rows of side 0 meet those of side 1.
    """
    names = ("token", "side", "unit", "sizes", "places")
    schema = pa.schema([(c.split()[0], pa.int64()) for c in MET.split(", ")])

    def counted(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        u, v, *sizes = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((v, u))
        u, v, sizes = u[order], v[order], [c[order] for c in sizes]
        at = np.flatnonzero(np.concatenate([[True], (np.diff(u) != 0) | (np.diff(v) != 0)]))
        times = np.diff(np.concatenate([at, [len(u)]]))
        spread = [(np.minimum if k % 2 == 0 else np.maximum).reduceat(c, at) for k, c in enumerate(sizes)]
        found = [pa.array(c.astype(np.int64)) for c in (u[at], v[at], times, *spread)]
        return pa.RecordBatch.from_arrays([*found, *[pa.nulls(len(at), pa.int64())] * 4], schema=schema)

    def set_aside(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        kept = [pa.array(c.astype(np.int64)) for c in (columns[0], *columns[2:])]
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(columns[0]), pa.int64())] * 7, *kept], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size, aside = None, [], 0, None

        def meet(columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            nonlocal found, size
            edges = np.flatnonzero(np.diff(columns[0])) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(columns[0])]])
            many = np.flatnonzero(ends - starts > 1)
            for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                side, unit, sizes, places = (c[a:b] for c in columns[1:])
                low, high, *rest = unpack(sizes, places)
                x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                for i, j in _meetings(x, y if len(y) else x, not len(y), unit, low, high, *rest):
                    first, second = np.where(unit[i] < unit[j], i, j), np.where(unit[i] < unit[j], j, i)
                    found.append((unit[first], unit[second], low[first], high[first], low[second], high[second]))
                    size += len(i)
                    if size > HELD_PAIRS:
                        yield counted(found)
                        found, size = [], 0

        for batch in batches:
            columns = tuple(np.asarray(batch.column(c)) for c in names)
            if aside is not None and len(columns[0]):  # the rest of a token that was set aside
                n = int(np.searchsorted(columns[0], aside, "right"))
                if n:
                    yield set_aside(tuple(c[:n] for c in columns))
                    columns = tuple(c[n:] for c in columns)
            if held is not None:
                columns = tuple(np.concatenate(c) for c in zip(held, columns, strict=True))
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last token may go on in the next batch
            if last:
                yield from meet(tuple(c[:last] for c in columns))
            held = tuple(c[last:] for c in columns)
            if len(held[0]) > hot:
                aside = held[0][0]
                yield set_aside(held)
                held = None
        if held is not None and len(held[0]):
            yield from meet(held)
        if size:
            yield counted(found)

    return dealt.mapInArrow(run, MET)


def meetings(matrix: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct pairs (a, b) of groups that meet in enough tokens of the matrix to have linked members."""
    in_turn = lambda df: df.select("token", "side", "unit", "sizes", "places").repartition("token").sortWithinPartitions("token")
    met = materialise(_met(in_turn(matrix.withColumn("side", F.lit(0).cast("long"))), hot), "met")
    pairs, aside = met.filter("a IS NOT NULL"), met.filter("token IS NOT NULL").select("token", "unit", "sizes", "places")
    if aside.limit(1).count():
        shape = aside.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("blocks"))
        cut = aside.join(small(shape), "token").withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
        # A row goes to each pair of blocks that its own is in: on side 0 of (own, later), on side 1 of (earlier, own).
        every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), (k < F.col("block")).cast("long").alias("side")))
        spread = cut.select("token", "unit", "sizes", "places", F.inline(every)).withColumn("token", F.xxhash64("token", "i", "j"))
        pairs = pairs.unionByName(_met(in_turn(spread), float("inf")).filter("a IS NOT NULL"))
    pairs = pairs.groupBy("a", "b")
    pairs = pairs.agg(F.sum("times").alias("times"), *[F.min(c).alias(c) for c in ("low_a", "low_b")], *[F.max(c).alias(c) for c in ("high_a", "high_b")])
    fixed = (F.col("low_a") == F.col("high_a")) & (F.col("low_b") == F.col("high_b"))
    need = F.when(fixed, needed(F.least("low_a", "low_b"), F.greatest("low_a", "low_b"))).otherwise(F.lit(1))
    return pairs.filter(F.col("times") >= need).select("a", "b")


def _up(x: Column, n: int) -> Column:
    return F.floor((x + (n - 1)) / n)


def _probed(n: Column) -> Column:
    return n - _up(4 * n, 5) + 1


def _index_part(n: Column) -> Column:
    return F.floor((_probed(n) + n - _up(8 * n, 9) + 1) / 2)


def needed(s: Column, t: Column) -> Column:
    """Of their prefixes' tokens, in how many sets of sizes s <= t at least meet if they link.

    They share i = ceil(4 (s + t) / 9) tokens, the first m of them in the first s - i + m and t - i + m tokens.
    """
    i = _up(4 * (s + t), 9)
    return F.least(_index_part(s) - s + i, _probed(t) - t + i)


def worth_asking(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """The rows of roles (host, sid, label, asks) that may have a link to another label's document on the other side of their host.

    For each token of a document's prefix it is told whether the other side has it in a document of another label
    and of a size that may link; a document that links with any other has at least needed() such tokens. That is
    told from the least and greatest label and size of each side, so work and rows are linear in the documents'
    tokens, whatever the size of the group.
    """
    own = docs.join(small(roles.select(F.col("sid").alias("doc_id")).distinct()), "doc_id").withColumn("unit", F.col("doc_id"))
    counts = sketch_of(materialise(profile(own), "opened"))
    found = entries(own, counts).select("token", F.col("unit").alias("sid"), F.shiftright("sizes", 32).alias("n"))
    found = found.join(small(roles), "sid").select(F.xxhash64("token", "host").alias("token"), "host", "sid", "label", "n", "asks")
    found, n = materialise(found, "opened-tokens"), F.col("n")
    # Extremes are combined before they are dealt; what a hot token's rows are told comes back by a join that can split them.
    ends = [(f"{name}_{c}", f, c) for c in ("label", "n") for name, f in (("least", F.min), ("most", F.max))]
    extremes = found.groupBy("token").agg(*[f(F.when(F.col("asks") == k, F.col(c))).alias(f"{name}_{k}") for name, f, c in ends for k in (0, 1)])
    across = [F.when(F.col("asks") == 0, F.col(f"{name}_1")).otherwise(F.col(f"{name}_0")).alias(name) for name, _, _ in ends]
    told = found.join(extremes, "token").select("host", "sid", "asks", "n", "label", *across)
    low, high = F.greatest("least_n", _up(4 * n, 5)), F.least("most_n", F.floor(5 * n / 4))
    met = told.filter(((F.col("least_label") != F.col("label")) | (F.col("most_label") != F.col("label"))) & (low <= high)).select("host", "sid", "asks", "n", low.alias("low"), high.alias("high"))
    met = met.groupBy("host", "sid", "asks").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    # Between its ends and n itself the bound is rising or falling, but for rounding.
    ends = [F.col("low"), F.col("high"), F.greatest("low", F.least("high", n))]
    least = F.least(*[needed(F.least(n, t), F.greatest(n, t)) for t in ends]) - 2
    fine = materialise(met.filter(F.col("times") >= least).select("host", "sid", "asks"), "worth")
    return roles.join(small(fine), ["host", "sid", "asks"], "left_semi")


def open_groups(docs: DataFrame, apart: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between members of the groups of each pair of apart, one for each member and component at least.

    members: unit, sid, n and label (its component so far) of all groups in apart. The smaller group's members
    are asked of the larger one's; in a group paired with itself, those outside its largest component. Both
    are dealt in parts of bounded size, the asked ones to each part of the asking ones and the other way round.
    """
    totals = members.groupBy("unit").agg(F.count(F.lit(1)).alias("members"))
    main = members.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("unit").agg(F.max(F.struct("n", "label")).alias("m")).select("unit", F.col("m.label").alias("main"))
    told = lambda side: totals.select(F.col("unit").alias(side), F.col("members").alias(f"m_{side}"))
    sides = apart.join(told("a"), "a").join(told("b"), "b")
    swap = F.col("m_a") < F.col("m_b")
    either = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    sides = sides.select(either("b", "a").alias("host"), either("a", "b").alias("guest"))
    asking = sides.join(members.join(main, "unit").withColumnRenamed("unit", "guest"), "guest").filter("host <> guest OR label <> main").select("host", "sid", "label").distinct()
    asking = materialise(asking, "asking")
    if not asking.limit(1).count():
        return docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    mine = members.withColumnRenamed("unit", "host").join(asking.select("host").distinct(), "host", "left_semi")
    roles = materialise(mine.select("host", "sid", "label", F.lit(0).alias("asks")).unionByName(asking.select("host", "sid", "label", F.lit(1).alias("asks"))), "roles")
    roles = materialise(worth_asking(docs, roles), "roles")
    sizes = roles.filter("asks = 0").join(members.select("sid", "n").distinct(), "sid").groupBy("host").agg(F.sum("n").alias("tokens"))
    shape = roles.filter("asks = 1").groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(sizes, "host")
    shape = shape.select("host", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks"), F.ceil(F.col("n") / ASKED).cast("int").alias("parts"))
    place = lambda n, salt: F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = roles.join(small(shape), "host")
    own = placed.filter("asks = 0").select("sid", "label", "host", place("blocks", 1).alias("block"), every("parts").alias("part"), "asks")
    ask = placed.filter("asks = 1").select("sid", "label", "host", place("parts", 2).alias("part"), every("blocks").alias("block"), "asks")
    roles = materialise(own.unionByName(ask), "dealt")
    dealt = docs.join(small(roles.withColumnRenamed("sid", "doc_id")), "doc_id").select("doc_id", "text", "label", "host", "block", "part", "asks")
    dealt = dealt.repartition("host", "block", "part").sortWithinPartitions("host", "block", "part", "asks", "doc_id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, labels, held, index = None, [], [], [], None
        for batch in batches:
            for part in slices(batch, "text"):
                links = []
                keys = zip(*(part.column(c).to_pylist() for c in ("host", "block", "part", "asks", "doc_id", "label")), strict=True)
                for s, (*key, asks, doc_id, label) in zip(shingle_sets(*raw(part.column("text"))), keys, strict=True):
                    if key != now:
                        now, ids, labels, held, index = key, [], [], [], None
                    if not asks:
                        ids.append(doc_id)
                        labels.append(label)
                        held.append(s)
                        continue
                    if index is None:
                        index = Postings(held)
                    links += {labels[k]: (ids[k], doc_id) for k in index.linked(s).tolist() if labels[k] != label}.values()
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    return dealt.mapInArrow(run, "a bigint, b bigint")


class Postings:
    """Sets by token, to find all that link with another set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.of = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def linked(self, s: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        a, b = a[a < b], b[a < b]
        if not len(a):
            return np.zeros(0, np.int64)
        common = np.bincount(np.concatenate([self.of[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]), minlength=len(self.sizes))
        return np.flatnonzero((common > 0) & (100 * common >= PERCENT * (self.sizes + len(s) - common)))


def _lead(found: DataFrame) -> DataFrame:
    """Pairs (a, b): in each class of equal min-hash the most copied document a with each other b of a size that may be similar."""
    keyed = found.select("sid", "n", "copies", F.explode(F.arrays_zip("near", F.array(F.lit(0), F.lit(1)).alias("which"))).alias("k"))
    keyed = keyed.select("sid", "n", "copies", F.col("k.near").alias("near"), F.col("k.which").alias("which"))
    best = keyed.groupBy("which", "near").agg(F.max(F.struct("copies", (-F.col("sid")).alias("minus"), "n")).alias("best"), F.count(F.lit(1)).alias("size"))
    best = best.filter("size > 1").select("which", "near", (-F.col("best.minus")).alias("a"), F.col("best.n").alias("n_a"))
    pairs = keyed.join(small(best), ["which", "near"]).filter(f"a <> sid AND 100 * n >= {SIMILAR} * n_a AND 100 * n_a >= {SIMILAR} * n")
    return pairs.select("a", F.col("sid").alias("b"))


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profiled = materialise(profile(own), "profiles")
    each = profiled.filter("block IS NULL").select("doc_id", "n", "digest", "near")
    found = each.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("sid"), F.first("n").alias("n"), F.first("near").alias("near"), F.count(F.lit(1)).alias("copies"))
    found = materialise(found, "sets")
    # Texts of one document for each set; the others are few enough to be told by broadcast, or it is a join.
    others = each.filter("n > 0").join(found.select("digest", "sid"), "digest").filter("doc_id <> sid").select("doc_id").join(found.select(F.col("sid").alias("doc_id")), "doc_id", "left_anti").distinct()
    others = materialise(others, "copies")
    unique = own.filter("doc_id IS NOT NULL")
    unique = unique.join(F.broadcast(others), "doc_id", "left_anti") if few(others) else unique.join(found.select(F.col("sid").alias("doc_id")), "doc_id", "left_semi")

    links = lambda pairs: pairs.filter(F.col("likeness") >= PERCENT).select("a", "b")
    stars = materialise(verify(unique, _lead(found)), "stars")
    groups = components(stars)
    members = unique.join(small(groups), F.col("doc_id") == F.col("id")).select("doc_id", "text", F.col("label").alias("unit"))
    single = unique.join(small(groups.select(F.col("id").alias("doc_id"))), "doc_id", "left_anti").withColumn("unit", F.col("doc_id"))
    sketch = sketch_of(profiled)
    met = materialise(meetings(entries(single, sketch).unionByName(combined(entries(members, sketch)))), "meetings")

    first = materialise(links(stars).unionByName(links(verify(unique, met))), "links")
    linked = components(first).select(F.col("id").alias("sid"), "label")
    units = groups.select(F.col("id").alias("sid"), F.col("label").alias("unit"))
    large = units.select("unit").distinct()
    told = lambda side: large.select(F.col("unit").alias(side), F.lit(1).alias(f"many_{side}"))
    open_ = met.join(told("a"), "a", "left").join(told("b"), "b", "left").filter("many_a = 1 OR many_b = 1").select("a", "b")
    open_ = materialise(open_.unionByName(large.select(F.col("unit").alias("a"), F.col("unit").alias("b"))), "open")
    alone = open_.select(F.explode(F.array("a", "b")).alias("unit")).distinct().join(large, "unit", "left_anti").select(F.col("unit").alias("sid"), "unit")
    inside = units.unionByName(alone).join(found.select("sid", "n"), "sid").join(linked, "sid", "left").select("unit", "sid", "n", F.coalesce("label", "sid").alias("label"))
    inside = materialise(inside, "members")
    spread = inside.groupBy("unit").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    of = lambda side: spread.select(F.col("unit").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}"))
    apart = open_.join(of("a"), "a").join(of("b"), "b").filter("low_a <> high_a OR low_b <> high_b OR low_a <> low_b").select("a", "b")
    second = materialise(open_groups(unique, materialise(apart, "apart"), inside), "links")

    last = components(first.unionByName(second))
    to = found.select("digest", "sid").join(last.withColumnRenamed("id", "sid"), "sid", "left").select("digest", F.coalesce("label", "sid").alias("component"))
    out = each.join(to, "digest", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
