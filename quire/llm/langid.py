"""Language identification by hierarchical discrimination.

First a family is chosen (linear classifiers, one against the rest), then the language within it by linear
support vector machines, one for each pair of the family's languages, which vote. All machines read the same
features: the shares of hashed byte n-grams of one to three bytes of the text, A-Z lower-cased, with everything
but letters read as a space. Features are counted block by block, so long texts need no more memory than their bytes.

The hierarchy is a tree: a node has at most FAN children and a last family at most CLOSE languages. A larger family is
cut again into families of like languages, and so are very many families, along the direction in which their mean
features differ most. So the machines grow with the number of labels and not with its square, and a text meets those
on its own way down the tree only. The model is broadcast to the tasks: about 60 kB a label.

Training: a sample of SAMPLE rows of each label, or as many as TOTAL rows in all allow, chosen by a hash of doc_id and
text; a label of fewer rows gives all of them. These two bounds are the only ones: they keep the training rows (sparse,
a few kB each) to what the driver and a task can hold. If there are more than TOTAL labels, TOTAL of them, chosen by a
hash, give a row each and the others can't be predicted. The machines are fitted in tasks. The label counts and the
prediction cover all rows.

Families: labels of the table FAMILIES are in the family named there. Any other label joins the family whose mean
features are most like its own, if the cosine of the two reaches NEAR, else it founds one, in the order of names.

Defined cases: lang_pred is `und` with score 0 for null texts, for texts without a letter, and for all rows
when no labelled row has a letter. With one language every other text gets it. A null label is not learned; the
empty string is a label like others. The score is the probability of the family times that of the language in it, by logistic
curves fitted to the margins of the training rows. Rows are kept one for one, repeated rows too; clashing
columns are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import raw, with_columns
from .shared import fresh, materialise, small

SAMPLE, TOTAL = 1000, 8000
#: Children of a node, languages of a last family, at most; rows of a label between which its sample is chosen, at least.
FAN, CLOSE, LEAST = 8, 8, 16
#: Texts whose features are held at once; tasks that fit machines.
TEXTS, TASKS = 256, 256
#: The cosine of mean features from which a label without a known family joins one.
NEAR = 0.5
BITS = 12
BUCKETS = 1 << BITS
#: Bytes whose n-grams are made at once.
BLOCK = 1 << 17
UNKNOWN = "und"
#: Gradient steps of the support vector machines, and their regularisation.
ROUNDS, PENALTY = 200, 1e-3
#: Families of written languages; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa sa si ur",
    "semitic": "ar am he mt",
    "celtic": "br cy ga gd",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def _byte_classes() -> np.ndarray:
    """Letters of ASCII in lower case, all bytes beyond ASCII as they are, everything else a space."""
    out = np.full(256, 32, np.uint64)
    for b in range(256):
        if b >= 128 or chr(b).isalpha():
            out[b] = b | 32 if b < 128 else b
    return out


CLASSES = _byte_classes()


def grams(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Block by block, each byte's text and the buckets of the n-grams that end there, for n of 1, 2 and 3.

    Bucket 0 is for those that end in a space or begin in another text.
    """
    for low in range(0, len(data), BLOCK):
        lead = min(low, 2)
        one = CLASSES[data[low - lead : low + BLOCK]]
        at = np.arange(low, low + len(one) - lead)
        of = np.searchsorted(ends, at, side="right") - 1
        inside = at - ends[of]
        blank, found, code = one[lead:] == 32, [], np.zeros(len(one), np.uint64)
        for n in range(3):
            code = code * np.uint64(256)
            code[n:] += one[: len(one) - n] if n else one
            g = (((code + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)[lead:]
            g[blank | (inside < n)] = 0
            found.append(g)
        yield of, found


def shares(data: np.ndarray) -> np.ndarray:
    """One text's features: how often each bucket occurs among its n-grams."""
    counts = np.zeros(BUCKETS, np.float32)
    for _, found in grams(data, np.array([0, len(data)])):
        for g in found:
            counts += np.bincount(g, minlength=BUCKETS)
    counts[0] = 0
    return counts / max(counts.sum(), 1)


def features(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The number of the first text, and shares() of it and those behind it, a row each, TEXTS at a time."""
    for low in range(0, len(ends) - 1, TEXTS):
        some = ends[low : low + TEXTS + 1]
        x = np.zeros((len(some) - 1, BUCKETS), np.float32)
        for of, found in grams(data[some[0] : some[-1]], some - some[0]):
            first, n = of[0], of[-1] - of[0] + 1
            at = (of - first).astype(np.int64) * BUCKETS
            for g in found:
                x[first : first + n] += np.bincount(at + g, minlength=n * BUCKETS).reshape(n, BUCKETS)
        x[:, 0] = 0
        yield low, x / np.maximum(x.sum(axis=1), 1)[:, None]


@dataclass
class Node:
    """Languages below, children (none: a last family), and its machines: one a child, or one a pair of languages."""

    langs: list[str]
    children: list[Node]
    first: int = 0

    def pairs(self) -> list[tuple[int, int]]:
        n = len(self.langs)
        return [(i, j) for i in range(n) for j in range(i + 1, n)]

    def machines(self) -> list[tuple[list[str], list[str]]]:
        """Of each machine the languages on its one side and on its other."""
        if self.children:
            return [(c.langs, [v for d in self.children if d is not c for v in d.langs]) for c in self.children]
        return [([self.langs[i]], [self.langs[j]]) for i, j in self.pairs()]

    def below(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.below()


@dataclass
class Model:
    """The tree of families, and of each machine a row of weights, its bias and the slope of its logistic curve."""

    root: Node
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray

    def judge(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of texts with these features, one row a text."""
        out, score = [""] * len(x), np.ones(len(x))
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            own = slice(node.first, node.first + (len(node.children) or len(node.pairs())))
            margin = x[rows] @ self.weights[own].T + self.bias[own]
            sure = 1 / (1 + np.exp(-np.clip(margin * self.slope[own], -30, 30)))
            if node.children:
                of = np.argmax(margin, axis=1)
                score[rows] *= sure[np.arange(len(rows)), of]
                todo += [(c, rows[of == k]) for k, c in enumerate(node.children)]
                continue
            votes, chance = np.zeros((len(rows), len(node.langs))), np.ones((len(rows), len(node.langs)))
            for p, (i, j) in zip(sure.T, node.pairs(), strict=True):
                votes[:, i] += p > 0.5
                votes[:, j] += p <= 0.5
                chance[:, i] = np.minimum(chance[:, i], p)
                chance[:, j] = np.minimum(chance[:, j], 1 - p)
            won = np.argmax(votes + chance / 2, axis=1)
            score[rows] *= chance[np.arange(len(rows)), won]
            for r, w in zip(rows.tolist(), won.tolist(), strict=True):
                out[r] = node.langs[w]
        return out, np.clip(score, 0, 1)


def svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient steps; both classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = np.zeros(x.shape[1] + 1, np.float32)
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    z, t = w.copy(), 1.0
    step = np.float32(1 / (2 * (float(weight @ np.einsum("ij,ij->i", x, x)) + 1) + PENALTY))
    for _ in range(ROUNDS):
        gap = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1])) * y * weight
        grad = np.append(PENALTY * z[:-1] - 2 * (x.T @ gap), -2 * gap.sum())
        new = z - step * grad
        again = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + np.float32((t - 1) / again) * (new - w), new, again
    return w[:-1], float(w[-1])


def slope_of(margin: np.ndarray, y: np.ndarray) -> float:
    """The steepness of the logistic curve that fits these margins, by a few trials."""
    trials = np.geomspace(0.5, 16, 11)
    return float(min(trials, key=lambda s: np.logaddexp(0, -np.clip(s * margin * y, -30, 30)).mean() + 1e-3 * s))


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Feature rows, each packed as its buckets (int32) and their shares (float32)."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, packed in enumerate(rows):
        half = len(packed) // 2
        x[k, np.frombuffer(packed[:half], np.int32)] = np.frombuffer(packed[half:], np.float32)
    return x


def scale_of(rows: list[bytes]) -> np.ndarray:
    """For each bucket what evens out frequent and rare n-grams, over all training rows."""
    sums = np.zeros(BUCKETS)
    for packed in rows:
        half = len(packed) // 2
        sums[np.frombuffer(packed[:half], np.int32)] += np.frombuffer(packed[half:], np.float32).astype(float) ** 2
    spread = (sums / len(rows)) ** 0.5
    return np.where(spread > 0, 1 / np.sqrt(np.maximum(spread, 1e-9)), 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.linalg.norm(x)), 1e-12)


def means_of(langs: list[str], rows: list[bytes], scale: np.ndarray) -> dict[str, np.ndarray]:
    """The direction of each language's mean features."""
    sums = {v: np.zeros(BUCKETS) for v in sorted(set(langs))}
    for v, packed in zip(langs, rows, strict=True):
        half = len(packed) // 2
        sums[v][np.frombuffer(packed[:half], np.int32)] += np.frombuffer(packed[half:], np.float32)
    return {v: unit(x * scale).astype(np.float32) for v, x in sums.items()}


def families_of(means: dict[str, np.ndarray]) -> dict[str, str]:
    """The family of each language."""
    found = {v: FAMILY_OF[v] for v in means if v in FAMILY_OF}
    names = sorted(set(found.values()))
    sums = np.zeros((len(means), BUCKETS), np.float32)
    for v, f in found.items():
        sums[names.index(f)] += means[v]
    norms = np.linalg.norm(sums, axis=1)
    for v in (v for v in means if v not in found):
        like = sums[: len(names)] @ means[v] / np.maximum(norms[: len(names)], 1e-12)
        best = int(np.argmax(like)) if names else -1
        if best < 0 or like[best] < NEAR:
            best = len(names)
            names.append(v)
        found[v] = names[best]
        sums[best] += means[v]
        norms[best] = np.linalg.norm(sums[best])
    return found


def arranged(nodes: list[Node], means: dict[str, np.ndarray]) -> list[Node]:
    """Nodes along the direction in which their centres differ most (by power iteration)."""
    centres = np.stack([sum(means[v] for v in n.langs) / len(n.langs) for n in nodes])
    centres = centres - centres.mean(axis=0)
    axis = unit(centres[int(np.argmax(np.linalg.norm(centres, axis=1)))])
    for _ in range(20):
        axis = unit(centres.T @ (centres @ axis))
    along = centres @ axis
    return [nodes[k] for k in sorted(range(len(nodes)), key=lambda k: (round(float(along[k]), 6), nodes[k].langs))]


def gathered(nodes: list[Node], most: int, means: dict[str, np.ndarray], join: Callable[[list[Node]], Node]) -> list[Node]:
    """Like nodes joined, `most` at a time at most and evenly."""
    n = -(-len(nodes) // most)
    order = arranged(nodes, means)
    return [join(order[k * len(order) // n : (k + 1) * len(order) // n]) for k in range(n)]


def inner(children: list[Node]) -> Node:
    return children[0] if len(children) == 1 else Node([v for c in children for v in c.langs], children)


def tree_of(means: dict[str, np.ndarray]) -> Node:
    """The tree of families; its machines are numbered from the root on."""
    family_of = families_of(means)
    families = []
    for f in sorted(set(family_of.values())):
        own = [Node([v], []) for v in means if family_of[v] == f]
        nodes = gathered(own, CLOSE, means, lambda some: Node(sorted(v for n in some for v in n.langs), [])) if len(own) > CLOSE else [Node([n.langs[0] for n in own], [])]
        while len(nodes) > FAN:
            nodes = gathered(nodes, FAN, means, inner)
        families.append(inner(nodes))
    while len(families) > FAN:
        families = gathered(families, FAN, means, inner)
    root, first = inner(families), 0
    for node in root.below():
        node.first = first
        first += len(node.children) or len(node.pairs())
    return root


def fit(spark: SparkSession, langs: list[str], rows: list[bytes]) -> Model:
    """A model from packed feature rows and their languages; machines are dealt to TASKS tasks at most."""
    scale = scale_of(rows)
    root = tree_of(means_of(langs, rows, scale))
    machines = [m for node in root.below() for m in node.machines()]
    bias, slope, w = np.zeros(len(machines)), np.zeros(len(machines)), np.zeros((len(machines), BUCKETS), np.float32)
    if machines:
        norm = max(float(sum(((np.frombuffer(r[len(r) // 2 :], np.float32) * scale[np.frombuffer(r[: len(r) // 2], np.int32)]) ** 2).sum() for r in rows)) ** 0.5 / len(rows) ** 0.5, 1e-9)
        shared = spark.sparkContext.broadcast((langs, rows, scale, norm, machines))  # at most TOTAL rows
        schema = pa.schema([("k", pa.int64()), ("bias", pa.float64()), ("slope", pa.float64()), ("weights", pa.binary())])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, rows, scale, norm, machines = shared.value
            places: dict[str, list[int]] = {}
            for i, v in enumerate(langs):
                places.setdefault(v, []).append(i)
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    one, other = ([i for v in side for i in places[v]] for side in machines[k])
                    x = unpacked([rows[i] for i in one + other])
                    x *= (scale / norm).astype(np.float32)
                    y = np.repeat([1.0, -1.0], [len(one), len(other)])
                    found, b = svm(x, y)
                    told = (found * scale / norm).astype(np.float32)
                    yield pa.RecordBatch.from_pylist([{"k": k, "bias": b, "slope": slope_of(x @ found + b, y), "weights": told.tobytes()}], schema)

        for r in spark.range(len(machines), numPartitions=min(len(machines), TASKS)).mapInArrow(run, "k bigint, bias double, slope double, weights binary").toLocalIterator():
            bias[r["k"]], slope[r["k"]], w[r["k"]] = r["bias"], r["slope"], np.frombuffer(r["weights"], np.float32)
        shared.unpersist()
    w[:, 0] = 0
    return Model(root, w, bias, slope)


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("\\p{L}")), F.lit(False))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, total: int = TOTAL) -> Model | None:
    """A model from labelled rows; None if none of them has a letter."""
    told = labelled.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    usable = told.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = materialise(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "labels")
    labels = counts.count()
    if not labels:
        return None
    span, each = 1 << 30, max(1, min(sample, total // labels))
    # Twice the sample is chosen by hash, LEAST rows at least, and of these the first: no label of few rows is missed by chance.
    limit = F.ceil(F.lit(max(2 * each, LEAST) * span) / F.col("n"))
    limits = counts.filter(F.pmod(F.xxhash64("lang"), F.lit(labels)) < total).select(F.col("lang").alias("label"), limit.alias("limit"))
    place = F.pmod(F.xxhash64("key", "text"), F.lit(span))  # the text too: rows of one key, or of none, do not fall together
    near = usable.withColumn("place", place).join(small(limits), F.col("lang") == F.col("label")).filter("place < limit").dropDuplicates(["lang", "place"])
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    chosen = near.withColumn("nth", order).filter(F.col("nth") <= each).select("lang", "text")

    def make():
        def work(part: pa.RecordBatch):
            data, ends = raw(part.column("text"))
            packed = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                x = shares(data[a:b])
                at = np.flatnonzero(x).astype(np.int32)
                packed.append(at.tobytes() + x[at].tobytes())
            return [pa.array(packed, pa.binary())]

        return work

    rows = sorted((r["lang"], bytes(r["packed"])) for r in with_columns(materialise(chosen, "sample"), "packed binary", make, by="text", drop=["text"]).collect())
    return fit(labelled.sparkSession, [v for v, _ in rows], [x for _, x in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred and score."""
    if model is None:
        return docs.drop("lang_pred", "score", *drop).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    (flag,) = fresh(docs, "letter")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(part: pa.RecordBatch):
            data, ends = raw(part.column(text))
            langs, score = [], []
            for _, x in features(data, ends):
                found, sure = model.judge(x)
                langs += found
                score += sure.tolist()
            known = part.column(flag).to_pylist()
            return [
                pa.array([v if k else UNKNOWN for v, k in zip(langs, known, strict=True)], pa.string()),
                pa.array([float(s) if k else 0.0 for s, k in zip(score, known, strict=True)], pa.float64()),
            ]

        return work

    return with_columns(docs.withColumn(flag, has_letter(F.col(text))), "lang_pred string, score double", make, by=text, drop=[flag, *drop])


def held_out(key: Column) -> Column:
    """Rows that training must not see: crc32 of the key as text leaves 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "utf-8")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with held_out, lang_pred and score; learned from the rows that are not held out."""
    model = train(docs.filter(~held_out(F.col(key))).select(key, text, lang), text, lang, key, sample)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "held_out"]
    return predict(docs.select(*kept, held_out(F.col(key)).alias("held_out")), model, text, drop)
