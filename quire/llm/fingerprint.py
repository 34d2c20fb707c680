"""Document fingerprints: Merkle trees over sentences, paragraphs and sections.

A line is a paragraph; its sentences (ends of . ! ?, at most SENTENCE characters) are the leaves. Paragraphs
make sections, which end at a blank line or after a paragraph whose digest says so (one in SECTION), so that
borders come back after an edit. The digest of a node is that of its children's digests in order. The
fingerprint is a string: the root's digest, then the sections' short digests, each with its paragraphs', each
with its leaves'. Equal texts have equal fingerprints; different roots mean different texts. Comparing two
fingerprints goes down only into branches that differ, and so locates edits; the likeness of two fingerprints is
the share of leaves that they have in common (Dice, with multiplicity), 1 for equal roots only.

Comparison with the next document: the rows are parted by ranges of doc_id and sorted, one range a task, and
the first row of each range also visits the range above it, where it is the next document of the last row.
Tasks hold two documents at a time.

Defined cases: null text is empty text, whose tree has no leaf and is unlike any other. Documents are ordered by
doc_id (null the smallest), then by the text's hash; a single row is its own next document. Repeated rows follow
each other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucket_of, id_bounds, partitions

SENTENCE, SECTION = 64, 8
#: Hex digits of a root, and of a node below it.
ROOT, NODE = 32, 8
LEAF = re.compile(rf"[^.!?]{{0,{SENTENCE}}}[.!?]*")


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=ROOT // 2).digest()


def tree(text: str) -> tuple[bytes, list[tuple[bytes, list[tuple[bytes, list[bytes]]]]]]:
    """Root and sections; a section has its digest and paragraphs, a paragraph its digest and leaves."""
    sections, open_ = [], []

    def close() -> None:
        if open_:
            sections.append((_digest(b"s" + b"".join(p for p, _ in open_)), open_.copy()))
            open_.clear()

    for line in text.split("\n") if text else ():
        leaves = [blake2b(x.encode("utf-8", "surrogatepass"), digest_size=ROOT // 2).digest() for x in LEAF.findall(line) if x]
        paragraph = _digest(b"p" + b"".join(leaves))
        open_.append((paragraph, leaves))
        if not line.strip() or paragraph[0] % SECTION == 0:
            close()
    close()
    return _digest(b"d" + b"".join(s for s, _ in sections)), sections


def spell(root: bytes, sections: list) -> str:
    """A tree as a string: root;section:paragraph=leaf,leaf/paragraph=...;section:..."""
    cut = NODE // 2
    return ";".join([root.hex(), *(s[:cut].hex() + ":" + "/".join(p[:cut].hex() + "=" + ",".join([x[:cut].hex() for x in leaves]) for p, leaves in ps) for s, ps in sections)])


def fingerprint(text: str | None) -> str:
    return spell(*tree(text or ""))


def read(spelled: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    root, *sections = spelled.split(";")
    out = []
    for s in sections:
        name, _, body = s.partition(":")
        paragraphs = []
        for p in body.split("/"):
            own, _, leaves = p.partition("=")
            paragraphs.append((own, leaves.split(",") if leaves else []))
        out.append((name, paragraphs))
    return root, out


Branch = tuple[str, list]


def _differing(a: list[Branch], b: list[Branch]) -> tuple[list[Branch], list[Branch]]:
    """The branches of a and of b that the other does not have, with multiplicity."""
    spare, left = Counter(x for x, _ in b), []
    for branch in a:
        if spare[branch[0]]:
            spare[branch[0]] -= 1
        else:
            left.append(branch)
    right = []
    for branch in reversed(b):
        if spare[branch[0]]:
            spare[branch[0]] -= 1
            right.append(branch)
    return left, right[::-1]


def size(sections: list[Branch]) -> int:
    """Leaves of a tree."""
    return sum(len(leaves) for _, ps in sections for _, leaves in ps)


def share(a: list[Branch], b: list[Branch]) -> float:
    """The share of leaves that two different trees have in common: less than 1."""
    n = size(a) + size(b)
    if not n:
        return 0.0
    below = lambda side: [x for _, under in side for x in under]
    a, b = _differing(a, b)
    a, b = _differing(below(a), below(b))
    extra = Counter(below(a))
    extra.subtract(below(b))
    apart = sum(map(abs, extra.values()))
    return min((n - apart) / n, 1 - 1 / (n + 1))


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 if and only if the roots are equal."""
    return 1.0 if a[:ROOT] == b[:ROOT] else share(read(a)[1], read(b)[1])


def _gaps(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Where two lists differ: (first, end) in a and in b. Items that both hold once, in one order, are the fixed points."""
    once = lambda side: {x for x, n in Counter(side).items() if n == 1}
    both, place = once(a) & once(b), {x: k for k, x in enumerate(b)}
    tops, links = [], []  # the longest rising run of places in b
    for i, x in enumerate(a):
        if x in both:
            k = bisect_left(tops, place[x], key=lambda t: links[t][1])
            links.append((i, place[x], tops[k - 1] if k else None))
            tops[k : k + 1] = [len(links) - 1]
    fixed, at = [(len(a), len(b))], tops[-1] if tops else None
    while at is not None:
        fixed.append(links[at][:2])
        at = links[at][2]
    out, i, j = [], 0, 0
    for x, y in reversed(fixed):
        end_i, end_j = x, y
        while i < end_i and j < end_j and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < end_i and j < end_j and a[end_i - 1] == b[end_j - 1]:
            end_i, end_j = end_i - 1, end_j - 1
        if i < end_i or j < end_j:
            out.append((i, end_i, j, end_j))
        i, j = x, y
    return out


def _edits(a: list[Branch], b: list[Branch], depth: int, base_a: int, base_b: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Ranges of differing leaves of two lists of sections (depth 2), of paragraphs (1) or of leaves (0)."""
    named = lambda side: [x if depth == 0 else x[0] for x in side]
    leaves = lambda side: len(side) if depth == 0 else sum(len(x) for _, x in side) if depth == 1 else size(side)
    i = j = 0
    for x, end_x, y, end_y in _gaps(named(a), named(b)):
        base_a, base_b, i, j = base_a + leaves(a[i:x]), base_b + leaves(b[j:y]), x, y
        if depth:
            yield from _edits([p for _, below in a[x:end_x] for p in below], [p for _, below in b[y:end_y] for p in below], depth - 1, base_a, base_b)
        else:
            yield (base_a, base_a + end_x - x), (base_b, base_b + end_y - y)


def locate_edits(a: str, b: str) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Where b differs from a: ((first, last + 1) leaves of a, the same of b) of each edit, found through differing branches only."""
    return [] if a[:ROOT] == b[:ROOT] else list(_edits(read(a)[1], read(b)[1], 2, 0, 0))


FIELDS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", pa.string())])


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """FIELDS of each row; the edited text ends in the beginning of the next document by falling doc_id.

    edits: where it differs from the document, as ranges of leaves, `12-15:12-17;40-41:42-42`.
    """
    spark, lowest = docs.sparkSession, -(1 << 63)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("place", F.coalesce("doc_id", F.lit(lowest)))
    bounds = id_bounds(own.select("place"), "place", partitions(spark))
    own = own.withColumn("bucket", bucket_of("place", bounds))
    # One row a range: the range above each range, and its first document.
    tops = sorted((r["bucket"], r["top"]) for r in own.groupBy("bucket").agg(F.max("place").alias("top")).collect())
    visits = F.array(F.struct("bucket", F.lit(0).alias("guest")))
    if tops:
        above = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
        to = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
        first = F.col("place").isin(list(above))
        visits = F.when(first, F.array(F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.try_element_at(to, F.col("place")).cast("int").alias("bucket"), F.lit(1).alias("guest")))).otherwise(visits)
    dealt = own.select("doc_id", "text", "place", F.inline(visits))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("guest", F.col("place").desc(), F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in _judged(_documents(batches)):
            rows.append(row)
            held += len(row[3]) + len(row[4])
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return dealt.select("doc_id", "text", "guest").mapInArrow(run, FIELDS)


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str, int]]:
    for batch in batches:
        ids, texts, guests = (batch.column(c) for c in ("doc_id", "text", "guest"))
        for k in range(len(ids)):
            yield ids[k].as_py(), texts[k].as_py(), guests[k].as_py()


def _judged(documents: Iterable[tuple[int | None, str, int]]) -> Iterator[tuple]:
    """Rows of FIELDS for one range in falling order; its guest, the next range's first document, comes last."""
    last = None
    for doc_id, text, guest in documents:
        spelled = fingerprint(text)
        tree_ = read(spelled)[1]
        if last is not None:
            own_id, own, own_spelled, own_tree = last
            n = len(own)
            edited = own[: n - n // 3] + text[: n // 3]
            edited_spelled = fingerprint(edited)
            same, edited_tree = edited_spelled[:ROOT] == own_spelled[:ROOT], read(edited_spelled)[1]
            near_edited = 1.0 if same else share(own_tree, edited_tree)
            near_next = 1.0 if spelled[:ROOT] == own_spelled[:ROOT] else share(own_tree, tree_)
            edits = ";".join(f"{x[0]}-{x[1]}:{y[0]}-{y[1]}" for x, y in ([] if same else _edits(own_tree, edited_tree, 2, 0, 0)))
            yield own_id, n, sha256(edited.encode()).hexdigest(), own_spelled, edited_spelled, near_edited, near_next, edits
        last = doc_id, text, spelled, tree_
        if guest:
            return
