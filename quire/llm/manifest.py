"""Merkle dataset manifest: a tree of digests over the rows of each group, and one over the groups' roots.

A row's leaf is the digest of its fields. A group's leaves stand in the order of their key; every `fanout`
consecutive nodes become one, a last run of fewer (even one) likewise, until one is left. The groups' roots, in the
order of the groups, make the dataset's root in the same way. Nothing is padded.

The narrow leaves are sorted by range, and each partition's part of a group, cut at RUN rows, is a run that knows
at which leaf of its group it begins. A task goes over a run with a stack: when a node is the last child of its
parent and its siblings stand before it, they are carried into the parent, so that the stack holds the peaks of a
mountain range. A run's first nodes may lie in a parent that began in the run before; these stay as peaks too. The
peaks of MERGE consecutive runs of a group meet in the next tier and go over a stack there, and so on until each
group is one run, whose only peak is its root: a tier has a few peaks for each run of the tier below. Every task
writes the nodes it made. Going back down the tiers, each peak is told the siblings on its way to the root, and a
leaf's proof is its way to a peak of its run and that peak's.

Defined cases: rows of a group are ordered by key (null first), rows of one key by leaf, equal leaves arbitrarily,
which no digest shows; groups are ordered by their name's UTF-8 bytes, null first. An empty table gives an empty
result. Kept columns that clash with the result's names, whatever their case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import materialise, partitions, small

#: Leaves of a run at most; runs of a tier whose peaks meet in one task.
RUN = 1 << 15
MERGE = 128
#: Rows of a partition of the sort at most.
SORTED = 1 << 21
NODE = "level int, place long, digest string"

#: A way up: for each level the digests of the siblings before and behind, the next level after it.
Way = tuple[str, str, "Way"] | None


def field(value: Column) -> Column:
    """A value as leaves hold it: `-` for null, else its UTF-8 bytes' number, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def join_digests(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def last_places(n: int, fanout: int) -> list[int]:
    """The last node's place on each level of a tree of n leaves; the last level has one node."""
    found = [n - 1]
    while found[-1]:
        found.append(found[-1] // fanout)
    return found


class Range:
    """The stack of a run: nodes (level, place, digest) from the left; made: children and parent of each carry."""

    def __init__(self, n: int, fanout: int):
        self.last, self.fanout, self.stack, self.made = last_places(n, fanout), fanout, [], []

    def push(self, level: int, place: int, digest: str) -> None:
        self.stack.append((level, place, digest))
        while level + 1 < len(self.last) and (place % self.fanout == self.fanout - 1 or place == self.last[level]):
            k = place % self.fanout + 1
            if len(self.stack) < k or self.stack[-k][:2] != (level, place - k + 1):
                return  # the run began within this parent
            children = self.stack[-k:]
            del self.stack[-k:]
            level, place = level + 1, place // self.fanout
            parent = (level, place, join_digests([c[2] for c in children]))
            self.made.append((children, parent))
            self.stack.append(parent)


def ways(run: Range, above: dict[tuple[int, int], Way]) -> dict[tuple[int, int], Way]:
    """The way of every node of a run that was a child in it, given those of its peaks."""
    found = dict(above)
    for children, (level, place, _) in reversed(run.made):
        up = found[level, place]
        digests = [c[2] for c in children]
        for i, c in enumerate(children):
            found[c[:2]] = ("".join(digests[:i]), "".join(digests[i + 1 :]), up)
    return found


def spread(way: Way) -> tuple[list[str], list[str]]:
    before, behind = [], []
    while way:
        before.append(way[0])
        behind.append(way[1])
        way = way[2]
    return before, behind


def gather(before: Sequence[str], behind: Sequence[str]) -> Way:
    way = None
    for b, a in zip(reversed(before), reversed(behind), strict=True):
        way = (b, a, way)
    return way


def fold(digest: str, way: Way) -> str:
    """The root that this digest and its siblings give."""
    while way:
        digest = sha256((way[0] + digest + way[1]).encode()).hexdigest()
        way = way[2]
    return digest


def _rows(table: pa.Table, *columns: str) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in columns), strict=True)


def _arrow(schema: pa.Schema, columns: Sequence[Sequence]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _same(rows: list[tuple], *keys: object) -> list[list]:
    """Columns of constants before those of rows."""
    return [[k] * len(rows) for k in keys]


class Forest:
    """Trees over leaves (tree string, key..., digest string): tiers of nodes from the runs up to the roots.

    runs: the leaves with n (leaves of their tree), place and run; tiers: (tree, n, run, level, place, digest, peak, made),
    the nodes that a tier made and the peaks that it left.
    """

    def __init__(self, leaves: DataFrame, order: Sequence[str], fanout: int):
        self.fanout = fanout
        self.runs = _placed(materialise(leaves, "leaves"), order)
        own = self.runs.select("tree", "n", "run", F.lit(0).alias("level"), "place", "digest")
        self.tiers = [self._tier(own)]
        while self.tiers[-1].filter("run > 0").limit(1).count():
            self.tiers.append(self._tier(self._met(self.tiers[-1])))

    @staticmethod
    def _met(tier: DataFrame) -> DataFrame:
        """The peaks of a tier as the items of the next one."""
        return tier.filter("peak").withColumn("run", F.floor(F.col("run") / MERGE).cast("long")).drop("peak", "made")

    def _tier(self, items: DataFrame) -> DataFrame:
        fanout, fields = self.fanout, StructType.fromDDL(f"tree string, n long, run long, {NODE}, peak boolean, made boolean")
        schema = to_arrow_schema(fields)

        def climb(table: pa.Table) -> pa.Table:
            tree, n, run = next(_rows(table.slice(0, 1), "tree", "n", "run"))
            mine = _stacked(table, n, fanout)
            made, peaks = {parent[:2] for _, parent in mine.made}, {node[:2] for node in mine.stack}
            rows = [(*node, True, node[:2] in made) for node in mine.stack]
            rows += [(*parent, False, True) for _, parent in mine.made if parent[:2] not in peaks]
            return _arrow(schema, [*_same(rows, tree, n, run), *zip(*rows, strict=True)])

        return materialise(items.groupBy("tree", "run").applyInArrow(climb, fields), "nodes")

    def roots(self) -> DataFrame:
        """(tree, digest) of each tree."""
        return self.tiers[-1].filter("peak").select("tree", "digest")

    def nodes(self) -> DataFrame:
        """(tree, level, place, digest) of every node above the leaves; a lone leaf has none."""
        return reduce(DataFrame.unionByName, [t.filter("made").select("tree", "level", "place", "digest") for t in self.tiers])

    def ways_of_peaks(self, above: DataFrame) -> DataFrame:
        """(tree, run, level, place, before, behind) for the peaks of the lowest tier; above: (tree, before, behind) of the roots."""
        top = self.tiers[-1].filter("peak").select("tree", "run", "level", "place")
        found = top.join(above, "tree")
        for k in range(len(self.tiers) - 1, 0, -1):
            found = materialise(self._down(self.tiers[k - 1], found), "ways")
        return found

    def _down(self, below: DataFrame, above: DataFrame) -> DataFrame:
        fanout, fields = self.fanout, StructType.fromDDL("tree string, run long, level int, place long, before array<string>, behind array<string>")
        schema = to_arrow_schema(fields)
        items = below.filter("peak").withColumnRenamed("run", "own").withColumn("run", F.floor(F.col("own") / MERGE).cast("long")).drop("peak", "made")

        def descend(mine: pa.Table, over: pa.Table) -> pa.Table:
            tree, n = next(_rows(mine.slice(0, 1), "tree", "n"))
            found = ways(_stacked(mine, n, fanout), _given(over))
            rows = [(own, level, place, *spread(found[level, place])) for own, level, place in _rows(mine, "own", "level", "place")]
            return _arrow(schema, [*_same(rows, tree), *zip(*rows, strict=True)])

        return items.groupBy("tree", "run").cogroup(above.groupBy("tree", "run")).applyInArrow(descend, fields)


def _stacked(table: pa.Table, n: int, fanout: int) -> Range:
    """A run's items over a stack, from the left."""
    found = Range(n, fanout)
    rows = sorted(_rows(table, "level", "place", "digest"), key=lambda r: r[1] * fanout ** r[0])
    for level, place, digest in rows:
        found.push(level, place, digest)
    return found


def _given(over: pa.Table) -> dict[tuple[int, int], Way]:
    return {(level, place): gather(before, behind) for level, place, before, behind in _rows(over, "level", "place", "before", "behind")}


def _placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Leaves with n, place and run: sorted by range, counted by partition and tree, cut at RUN rows."""
    spark = leaves.sparkSession
    parts = max(partitions(spark), leaves.count() // SORTED + 1)
    told = leaves.withColumn("nth", F.monotonically_increasing_id())  # parts rows that are equal in all else
    by = ["tree", *order, "digest", "nth"]
    dealt = told.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("nth")
    dealt = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    counts = counts.withColumn("cuts", F.ceil(F.col("rows") / RUN))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("tree").alias("t"), F.col("part").alias("p"), "first", F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"), F.coalesce(F.sum("cuts").over(before), F.lit(0)).alias("cut"),
    )
    counts = small(materialise(counts, "counts"))
    joined = dealt.join(counts, (F.col("tree") == F.col("t")) & (F.col("part") == F.col("p")))
    nth = F.col("at") - F.col("first")
    run = (F.col("cut") + F.floor(nth / RUN)).cast("long")
    return joined.select(*leaves.columns, "n", (F.col("begin") + nth).alias("place"), run.alias("run"))


def _told(forest: Forest, peaks: DataFrame, *columns: str) -> DataFrame:
    """The leaves of a forest with these columns and tree, digest, before, behind (their siblings by level), and
    folded: the root that `claimed`, or else the digest itself, makes with them."""
    kinds = forest.runs.schema
    fields = StructType.fromDDL("tree string, digest string, before array<string>, behind array<string>, folded string").fields + [kinds[c] for c in columns]
    schema, fanout, claims = to_arrow_schema(StructType(fields)), forest.fanout, "claimed" in columns

    def prove(mine: pa.Table, over: pa.Table) -> pa.Table:
        mine = mine.sort_by("place")
        n = mine.column("n")[0].as_py()
        found = ways(_stacked(mine, n, fanout), _given(over))
        digests, places = mine.column("digest").to_pylist(), mine.column("place").to_pylist()
        claimed = mine.column("claimed").to_pylist() if claims else digests
        up = [found[0, place] for place in places]
        both = [spread(way) for way in up]
        folded = [fold(c or d, way) for c, d, way in zip(claimed, digests, up, strict=True)]
        new = [[b for b, _ in both], [b for _, b in both], folded]
        made = [pa.array(c, t.type) for c, t in zip(new, list(schema)[2:5], strict=True)]
        return pa.Table.from_arrays([mine.column("tree"), mine.column("digest"), *made, *[mine.column(c) for c in columns]], names=schema.names)

    items = forest.runs.select("tree", "n", "run", F.lit(0).alias("level"), "place", "digest", *columns)
    return items.groupBy("tree", "run").cogroup(peaks.groupBy("tree", "run")).applyInArrow(prove, StructType(fields))


def tree_of(group: Column) -> Column:
    """A group's name such that null, which no name equals, comes first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


class Manifest:
    """The trees over rows with the columns group, key, leaf: of each group, and over the groups.

    claimed: a column of leaves to be held against the manifest; null where the row's own leaf is.
    """

    def __init__(self, rows: DataFrame, group: str, key: str, leaf: str, claimed: str | None = None, keep: Sequence[str] = (), fanout: int = 2):
        kept = {f"k{i}": c for i, c in enumerate(keep)}
        given = F.col(f"`{claimed}`") if claimed else F.lit(None).cast("string")
        leaves = rows.select(
            tree_of(F.col(f"`{group}`")).alias("tree"), F.col(f"`{key}`").alias("key"), F.col(f"`{leaf}`").alias("digest"), given.alias("claimed"), *[F.col(f"`{c}`").alias(k) for k, c in kept.items()]
        )
        self.kept, self.fanout = kept, fanout
        self.groups = Forest(leaves, ["key"], fanout)
        over = self.groups.roots().select(F.lit("all").alias("tree"), F.col("tree").alias("group"), "digest")
        self.whole = Forest(over, ["group"], fanout)

    def subroots(self) -> DataFrame:
        """(tree, digest) of each group: tree is empty for null, else `=` and the group."""
        return self.groups.roots()

    def root(self) -> str | None:
        found = self.whole.roots().first()
        return found["digest"] if found else None

    def nodes(self) -> DataFrame:
        """(tree, level, place, digest) of the groups' inner nodes."""
        return self.groups.nodes()

    def _above(self) -> DataFrame:
        """(tree, subroot, before, behind): the ways of the groups' roots up to the dataset's root."""
        none = F.array().cast("array<string>")
        top = self.whole.roots().select("tree", none.alias("before"), none.alias("behind"))
        return _told(self.whole, self.whole.ways_of_peaks(top), "group").select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "before", "behind")

    def proofs(self) -> DataFrame:
        """For each row: its kept columns, leaf, subroot, root; before and behind, its siblings on each level from the
        leaf's up to the root's children, digests joined; folded_root, which the claimed leaf makes with them; verified."""
        above = materialise(self._above(), "above")
        peaks = self.groups.ways_of_peaks(above.drop("subroot"))
        found = _told(self.groups, peaks, "claimed", *self.kept)
        roots = above.select("tree", "subroot")
        root = self.root()
        mine = {"leaf", "subroot", "root", "before", "behind", "folded_root", "verified"}
        return found.join(small(roots), "tree").select(
            *[F.col(k).alias(c) for k, c in self.kept.items() if c.lower() not in mine],
            F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "before", "behind", F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified"),
        )
