"""Jaccard join, line dedup and components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import components, jaccard, lines, shingles

BLANK = r"[\x20\x09-\x0D]"
DOCS = "doc_id long, text string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(f"{BLANK}+", lower(t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies(seed, groups=12, hot=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)] + ["Éa", "ß", "日本", "A.b"]
    rows, i = [], 1000
    common = [rng.choice(vocab) for _ in range(70)]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(2, 200))]
        now = base
        for _ in range(rng.randint(1, 12)):
            t = list(now if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            now = t
            rows.append((i, " ".join(t).upper() if rng.random() < 0.2 else "\t".join(t)))
            i += 1
    for _ in range(hot):  # a passage that many documents share
        rows.append((i, " ".join(common + [rng.choice(vocab) for _ in range(rng.randint(0, 30))])))
        i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x " * 30_000), (8, "x " * 29_000), (9, "x")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_shingles string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs).collect()}
    assert found == brute_components(rows)


def template_copies(seed, n=70):
    """Copies of one template with own words: similar throughout, some linked in chains, some with nothing, of two lengths."""
    rng = random.Random(seed)
    base = [f"t{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        t = list(base[: rng.choice([120, 112])])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            k = rng.randrange(0, len(t), rng.choice([1, 30]))
            t[k] = f"own{rng.choice([i, i // 7, 0])}"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("hot", [3, 16_384])
@pytest.mark.parametrize("seed", [3, 4])
def test_opened_groups_and_split_tokens_lose_no_link(spark, monkeypatch, seed, hot):
    """Groups of similar documents that link only in part, in many small blocks, with tokens that more than HOT groups hold."""
    monkeypatch.setattr(jaccard, "meetings", lambda matrix, f=jaccard.meetings: f(matrix, hot))
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(jaccard, "ASKED", 4)
    monkeypatch.setattr(jaccard, "HELD_PAIRS", 10)
    rows = template_copies(seed) + near_copies(seed, groups=3, hot=15)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert found == brute_components(rows)


def test_copies_of_a_template_with_texts_of_their_own_are_not_compared(spark, monkeypatch):
    """Similar but unlinked documents, each with a quarter of its own: none is worth asking, so none is dealt to a block."""
    rng, dealt = random.Random(6), []
    base = " ".join(f"t{rng.random()}" for _ in range(90))
    rows = [(i, base + " " + " ".join(f"o{i}x{k}" for k in range(32))) for i in range(300)]
    monkeypatch.setattr(jaccard, "worth_asking", lambda docs, roles, f=jaccard.worth_asking: dealt.append((roles.count(), f(docs, roles))) or dealt[-1][1])
    found = jaccard.link_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.doc_id == r.component_id for r in found)
    assert dealt[0][0] > 500 and dealt[0][1].count() == 0


def test_jaccard_of_repeated_rows_null_ids_and_empty_tables(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(5, text), (5, text), (7, text), (None, text), (9, "other")], DOCS)
    found = sorted(((r.doc_id, r.component_id) for r in jaccard.link_documents(docs).collect()), key=str)
    assert found == sorted([(5, 5), (5, 5), (7, 5), (None, None), (9, 9)], key=str)
    assert jaccard.link_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_threshold_is_exact():
    base = np.arange(100, dtype=np.uint64)
    assert shingles.likeness(base[:80], base) == 80
    assert shingles.likeness(base[:79], base) == 79
    assert shingles.likeness(base[:0], base[:0]) == 0


def test_shingles_do_not_depend_on_the_neighbours():
    texts = ["A b  c\td e f", "", "a B c d e f", "g", "  ", "a b c d e"]
    data = "".join(texts).encode()
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    many = shingles.shingle_sets(np.frombuffer(data, np.uint8), ends)
    alone = [shingles.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]
    assert [m.tolist() for m in many] == [a.tolist() for a in alone]
    assert many[0].tolist() == many[2].tolist() and len(many[0]) == 2 and set(many[5]) < set(many[0])


def test_blocks_of_long_texts_hash_alike(monkeypatch):
    text = " ".join(f"word{k}" for k in range(5000)).encode()
    data, ends = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = shingles.shingle_sets(data, ends)[0]
    monkeypatch.setattr(shingles, "BLOCK", 100)
    assert shingles.shingle_sets(data, ends)[0].tolist() == whole.tolist()


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(20)]
    star = [(100, 100 + k) for k in range(1, 30)]
    found = {r.id: r.label for r in components.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 130)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_lines(rows, threshold):
    key = lambda x: lower(re.sub(f"^{BLANK}+|{BLANK}+$", "", x))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                held.setdefault(key(x), set()).add(i)
    gone = {k for k, v in held.items() if len(v) >= threshold}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in gone]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def spread(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=str)


def line_rows(seed=3):
    rng = random.Random(seed)
    pool = ["Common Line", " common line\t", "Été", "été", "ÉTÉ", "x", "", "  ", "zz top", "long " * 50]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i} {k}" for k in range(6)]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "\n\n"), (63, "x\n" * 5000), (5, rows[5][1]), (5, rows[5][1]), (None, "x\nCommon line")]


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", n_lines string")
    assert spread(lines.dedup_lines(docs)) == brute_lines(rows, 10)
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("shipped", [lines.FILTER_BYTES, 0])
@pytest.mark.parametrize("few", [True, False])
def test_every_way_of_looking_up_gives_the_same(spark, monkeypatch, shipped, few):
    """Filters sent to the lines or asked in their shards, exact keys broadcast or joined by shuffle."""
    rows = line_rows(4)
    monkeypatch.setattr(lines, "few", lambda df: few)
    monkeypatch.setattr(lines, "FILTER_BYTES", shipped)
    assert spread(lines.dedup_lines(spark.createDataFrame(rows, DOCS))) == brute_lines(rows, 10)


def test_lines_keep_columns_of_any_name(spark):
    """Columns named like the operator's own stay, and rows of one doc_id with different texts lose each its own lines."""
    rows = [(i % 3 if i < 6 else i, f"common\nown {i}\n\ncommon " + "z" * i) for i in range(30)]
    docs = spark.createDataFrame([(*r, *range(6)) for r in rows], DOCS + ", _bad int, _doc int, _doc_ int, _gone_ int, `a.b` int, n_dropped int")
    found = lines.dedup_lines(docs, threshold=10).collect()
    assert all((r._bad, r._doc, r["_doc_"], r["_gone_"], r["a.b"]) == (0, 1, 2, 3, 4) for r in found)
    assert sorted(r.text for r in found) == sorted(f"own {i}\n\ncommon " + "z" * i if i else "own 0\n" for i in range(30)) and {r.n_dropped for r in found} == {1, 2}


def test_a_text_of_very_many_lines_is_cut_in_one_pass(spark):
    own = [("dropped", f"kept {k}")[k % 2] for k in range(100_000)]
    docs = spark.createDataFrame([(0, "\n".join(own)), *((k, "dropped") for k in range(1, 12))], DOCS)
    found = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert found[0].text == "\n".join(own[1::2]) and found[0].n_dropped == 50_000 and found[3].text == ""


def test_shards_follow_the_keys(spark, monkeypatch):
    """An index that outgrows its shards gets more of them, and holds and forgets the same keys."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 5)
    rows = [(i, "\n".join(f"line {k}" for k in range(60 if i % 2 else 5))) for i in range(12)]
    pairs = lines.document_keys(spark.createDataFrame(rows, DOCS)).cache()
    few = lines.insert_documents(lines.empty_index(spark, 2, 5), pairs.filter("doc_id % 2 = 0"))
    many = lines.insert_documents(few, pairs.filter("doc_id % 2 = 1"))
    assert few.shards == 2 and many.shards == 16 and lines.dropped_keys(many, pairs).count() == 60
    back = lines.delete_documents(many, pairs.filter("doc_id % 2 = 1"))
    assert lines.dropped_keys(back, pairs).count() == 5 and back.filters(spark).agg({"n_keys": "sum"}).first()[0] == 5


def test_deleting_documents_undoes_their_insertion(spark):
    rows = [r for r in line_rows(6) if r[0] is not None and r[0] != 5]
    pairs = lines.document_keys(spark.createDataFrame(rows, DOCS)).cache()
    half = lines.insert_documents(lines.empty_index(spark, 4, 5), pairs.filter("doc_id % 2 = 0"))
    both = lines.insert_documents(half, pairs.filter("doc_id % 2 = 1"))
    back = lines.delete_documents(both, pairs.filter("doc_id % 2 = 1"))
    counted = lambda index: {bytes(r.key): r.n_docs for r in index.counts(spark).collect()}
    assert counted(back) == counted(half) != counted(both)
    assert Counter(counted(both).values()) == Counter(counted(lines.insert_documents(lines.empty_index(spark, 4, 5), pairs)).values())
    asked = lambda index: {bytes(r.key) for r in lines.dropped_keys(index, pairs).collect()}
    assert asked(back) == asked(half) == {k for k, n in counted(half).items() if n >= 5}
    assert asked(both) == {k for k, n in counted(both).items() if n >= 5}
    left = lines.delete_documents(back, pairs.filter("doc_id % 2 = 0"))
    assert counted(left) == {} and asked(left) == set() and left.filters(spark).count() == 0


def test_cuckoo_filter_never_misses_and_forgets_what_is_deleted():
    keys = np.random.default_rng(1).integers(0, 256, (5000, 16), dtype=np.uint8)
    full = lines.CuckooFilter.build(keys[:4000])
    assert full.contains(keys[:4000]).all()
    assert full.contains(keys[4000:]).mean() < 0.01
    full.delete(keys[:2000])
    assert full.contains(keys[2000:4000]).all()
    assert full.contains(keys[:2000]).mean() < 0.01
    assert lines.CuckooFilter.load(full.dump()).contains(keys[2000:4000]).all()
    tiny = lines.CuckooFilter(4)
    assert not tiny.insert(keys)
