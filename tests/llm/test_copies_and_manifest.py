"""Exact dedup, filter audit and dataset manifest against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import permutations
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quire.llm import audit, exact, manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def some_texts(seed, n=300):
    rng = random.Random(seed)
    base = ["", " \t\n", "é日本 a", "A b\nc", "Ab c", "x" * 5000, " ".join(f"w{k}" for k in range(80)), "The #1 OFFER"] + [f"text {k} of {rng.random()}" for k in range(20)]
    rows = []
    for i in range(n):
        t = rng.choice(base) if rng.random() < 0.5 else base[3] if rng.random() < 0.6 else f"own {i}"
        if rng.random() < 0.3:
            t = t.replace(" ", "  ")
        rows.append((i * 3 % 1009, None if rng.random() < 0.02 else t, rng.choice(["en", "de", None, "", "fr"]), rng.choice(["s0", "s0", "s0", "s1", None]), len(t)))
    rng.shuffle(rows)
    return rows


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    return {content: (min(g)[3], len(g)) for content, g in groups.items()}


@pytest.mark.parametrize("room", [exact.TABLE_BYTES, 2500])
def test_copies_meet_whatever_the_tables_hold(spark, room):
    rows = some_texts(1, 100)
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    want = brute_copies([r[:2] for r in rows])
    got = exact.find_copies(docs, keep=["doc_id", "text"], room=room).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[bare(r["text"])]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
        assert r["content_sha256"] == sha(bare(r["text"]))


def test_small_tables_go_down_levels(spark):
    """Tables of 900 bytes: the text of 5,000 is larger than any, its copies are merged level by level."""
    rows = [(i, "y" * 5000 if i % 3 else f"t{i}", None, None, 0) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS).repartition(9)
    got = exact.find_copies(docs, room=900)
    assert got.filter("keep_id = 1 AND group_size = 80").count() == 80 and got.filter("kept").count() == 41


def test_table_compares_content_where_hashes_are_equal():
    table = exact.Table(4)
    assert table.place(7, b"a") == (0, True) and table.place(7, b"b") == (1, True) and table.place(7, b"a") == (0, False)
    for k in range(500):
        assert table.place(7 + k % 3, str(k).encode()) == (k + 2, True)
    assert table.place(8, b"1") == (3, False)


def test_copies_of_repeated_null_and_odd_rows(spark):
    docs = spark.createDataFrame([(5, "a b"), (5, "ab"), (5, "a b"), (None, "a b"), (None, None), (7, ""), (None, "a  b")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact.find_copies(docs).collect()), key=lambda r: (r[0], -r[2]))
    assert [g[:3] for g in got] == [(-1, None, 5), (-1, None, 5), (-1, 7, 2), (5, None, 5), (5, None, 5), (5, None, 5), (7, 7, 2)]
    assert sum(g[3] for g in got if g[2] == 5) == 1 and [g for g in got if g[2] == 2 and g[3]] == [(7, 7, 2, True)]


def test_dedup_returns_whole_rows_and_replaces_clashing_names(spark):
    rows = [(2, "a b", "x", 1, "t"), (1, "ab", "y", 2, "u"), (3, "long " * 40000, "z", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEEP_ID string, kept int, tab string")
    assert sorted(map(tuple, exact.dedup(docs).collect())) == [rows[0], rows[2]]
    found = exact.find_copies(docs, keep=docs.columns)
    assert found.columns == ["doc_id", "text", "tab", "keep_id", "group_size", "kept", "content_sha256"] and found.count() == 3
    assert exact.dedup(docs.limit(0)).count() == 0


def failing(text, copy):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text), "E": copy,
    }


def brute_audit(rows, labels):
    first = {}
    for i, t, _, _, _ in rows:
        if i is not None and t is not None:
            first[t] = min(i, first.get(t, i))
        elif i is not None:
            first[""] = min(i, first.get("", i))
    out = {}
    parts = defaultdict(list)
    for i, t, _, source, _ in rows:
        copy = i is not None and first.get(t or "", i) < i
        parts[source or ""].append((failing(t or "", copy), labels.get(i, (0, 0))))
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive, gone = docs, []
            for step, f in enumerate(order, 1):
                here = [d for d in alive if d[0][f]]
                late = sum(d[0][f] for d in gone)
                alive, gone = [d for d in alive if not d[0][f]], gone + here
                shapley[f] += len(here)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                out[part, "".join(order), step] = [len(alive), len(here), late, alone, sum(d[1][0] for d in here), sum(d[1][1] for d in here), f]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("room", [audit.CHAIN_BYTES, 500])
def test_audit_against_brute_force(spark, room, monkeypatch):
    monkeypatch.setattr(audit.masks, "__defaults__", (*audit.masks.__defaults__[:-1], room))
    rows = some_texts(2, 250) + [(4, "twice", None, "s1", 1), (4, "twice", None, "s1", 1), (None, "twice", None, "s0", 1), (9, "twice", None, None, 1)]
    labels = {i: (i % 2, int(i % 5 == 0)) for i in range(0, 1009, 4)}
    marks = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(4, 0, 0), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int")
    got = audit.audit(spark.createDataFrame(rows, DOCS).repartition(5), marks).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute_audit(rows, labels) and len(got) == 600 * 3


def test_audit_of_no_rows_and_with_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "bb " * 100000, "x")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), marks).count() == 0
    got = audit.audit(docs, marks, {"L": lambda data, words, points: points > 9, "E": audit.COPIES}).collect()
    assert sorted(tuple(r)[1:6] for r in got) == [("EL", 1, 2, 1, 0), ("EL", 2, 1, 1, 0), ("LE", 1, 2, 1, 0), ("LE", 2, 1, 1, 0)]


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def grow(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + fanout])) for k in range(0, len(last), fanout)])
    return levels


def siblings(levels, i, fanout):
    found = []
    for level in levels[:-1]:
        j = i // fanout * fanout
        found.append(("".join(level[j:i]), "".join(level[i + 1 : j + fanout])))
        i //= fanout
    return found


def brute_manifest(rows, fanout):
    trees = defaultdict(list)
    for i, t, lang, source, n in rows:
        trees["" if lang is None else "=" + lang].append((i is not None, i or 0, sha("".join(map(value, (i, source, lang, n, t)))), (i, n, t, lang, source)))
    names = sorted(trees, key=str.encode)
    grown = {k: grow([x[2] for x in sorted(trees[k], key=lambda x: x[:3])], fanout) for k in names}
    top = grow([grown[k][-1][0] for k in names], fanout)
    out = []
    for k in names:
        for place, x in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            i, n, t, lang, source = x[3]
            way = siblings(grown[k], place, fanout) + siblings(top, names.index(k), fanout)
            hit = i is not None and crc32(str(i).encode()) % 7 == 0
            d = sha("".join(map(value, (i, source, lang, n + 1 if hit and n is not None else n, t))))
            for left, right in way:
                d = sha(left + d + right)
            out.append((i, x[2], grown[k][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), d, d == top[-1][0]))
    return sorted(out, key=repr), sum(len(level) for g in grown.values() for level in g[1:])


@pytest.mark.parametrize(("fanout", "run", "merge"), [(2, 1 << 15, 128), (2, 5, 2), (3, 7, 3), (16, 3, 2), (2, 1, 2)])
def test_manifest_against_brute_force(spark, monkeypatch, fanout, run, merge):
    monkeypatch.setattr(manifest, "RUN", run)
    monkeypatch.setattr(manifest, "MERGE", merge)
    rows = some_texts(fanout, 90) + [(4, "twice", "en", "s1", None), (4, "twice", "en", "s1", None), (4, "thrice", "en", "s1", 1), (None, None, None, None, None), (1, "alone", "zz", "s", 2)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    own = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, manifest.leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in own]))
    made = manifest.Manifest(docs.select("*", manifest.leaf(*map(F.col, own)).alias("leaf"), changed.alias("claimed")), "lang", "doc_id", "leaf", "claimed", keep=["doc_id"], fanout=fanout)
    whole = F.sha2(F.concat_ws("", F.zip_with("before", "behind", lambda a, b: F.concat(a, b))), 256)
    got = sorted((tuple(r) for r in made.proofs().select("doc_id", "leaf", "subroot", "root", whole, "folded_root", "verified").collect()), key=repr)
    want, nodes = brute_manifest(rows, fanout)
    assert got == want
    assert made.nodes().count() == made.nodes().distinct().count() == nodes and made.root() == want[0][3]


def test_manifest_of_no_rows_one_row_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a" * 200_000, "kept")], "doc_id long, text string, ROOT string").withColumn("lang", F.lit(None).cast("string"))
    rows = docs.withColumn("leaf", manifest.leaf(F.col("doc_id"), F.col("text")))
    assert manifest.Manifest(rows.limit(0), "lang", "doc_id", "leaf", keep=["doc_id"]).proofs().count() == 0
    made = manifest.Manifest(rows, "lang", "doc_id", "leaf", keep=["doc_id", "ROOT"])
    (r,) = made.proofs().collect()
    assert r.asDict() == {"doc_id": 1, "leaf": sha("1:1200000:" + "a" * 200_000), "subroot": r["leaf"], "root": r["leaf"], "before": [], "behind": [], "folded_root": r["leaf"], "verified": True}
    assert made.nodes().count() == 0


def test_a_run_that_begins_within_a_parent_leaves_peaks():
    left, right = manifest.Range(8, 2), manifest.Range(8, 2)
    for i in range(3):
        left.push(0, i, sha(str(i)))
    for i in range(3, 8):
        right.push(0, i, sha(str(i)))
    assert [x[:2] for x in left.stack] == [(1, 0), (0, 2)] and [x[:2] for x in right.stack] == [(0, 3), (2, 1)]
    both = manifest.Range(8, 2)
    for x in left.stack + right.stack:
        both.push(*x)
    assert both.stack == [(3, 0, grow([sha(str(i)) for i in range(8)], 2)[-1][0])]
