"""Packing, fingerprints, BPE, quality, language ID and URL filters on small fixtures."""

import hashlib
import itertools
import random
import re
import resource
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe, fingerprint, langid, packing, quality, url_filter, wordtok

DOCS = "doc_id long, text string"
LONG = "Lorem ipsum dolor. " * 4000
ODD = [None, "", " ", "\n\n", "a", "<|endoftext|> x <|startoftext|>", "Ünï çødé ΣΑΣ 🙂 中文", "it's they'RE 123 ²½\x00\x1c\x85", LONG]


def library(path):
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def strange_texts(seed, n=1500):
    rng = random.Random(seed)
    letters = "ab '  \n\t\r\x0b\x0c\x1c\x85\xa0 é\u00df\u0301中🙂0१²'s're_-–\u200b\ufeffΑΣİ<|endoftext|>Ⱥǅ!?."
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# --- BPE


def test_bpe_equals_the_library(spark):
    tok, texts = library(bpe.default_path()), ODD + strange_texts(1)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumnRenamed("doc_id", "ids").selectExpr("ids AS doc_id", "text", "'x' AS n_tokens")
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == tok.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")


def test_bpe_long_texts_piecewise(monkeypatch):
    own, tok = bpe.Encoder(bpe.default_path()), library(bpe.default_path())
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    texts = ["many words <|endoftext|>  and   more " * 40, "short", "x" * 999, ""]
    found = own.encode_batch(texts)
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


def test_bpe_words_are_cut_as_the_library_cuts_them(monkeypatch):
    """Code points that the pattern engine and the library class differently: alone, in runs, and in long texts."""
    own, tok = bpe.Encoder(bpe.default_path()), library(bpe.default_path())
    points = [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x20000, 0x34000, 16)]
    own._meet("".join(chr(c) for c in points))
    differ = sorted(own.strange)
    firsts = [c for k, c in enumerate(differ) if not k or ord(c) > ord(differ[k - 1]) + 16]
    texts = ["\U0001dff6慶", "\U00033388轳", *(x for c in firsts for x in (f"a{c}", f"{c}b 1{c}", f"!{c}{c}?  {c}'s"))]
    rng = random.Random(12)
    letters = [*"ab 1!'s\n\t é慶\u3000", "\U00033388", "\u0558", "\ua7ce", *rng.sample(differ, min(len(differ), 20))]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    for at_once in (200_000, 40):
        monkeypatch.setattr(bpe, "WORDS_AT_ONCE", at_once)
        for text, ids in zip(texts, own.encode_batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_bpe_decodes_broken_bytes_as_the_library_does():
    own, tok = bpe.Encoder(bpe.default_path()), library(bpe.default_path())
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(6)]
        assert own.decode(np.array(ids, "<u4").tobytes()) == tok.decode(ids, skip_special_tokens=False)


def test_bpe_empty_table(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], DOCS))).collect() == []


# --- packing


def test_word_tokenizer_equals_the_library():
    tok, texts = library(wordtok.default_path()), [t or "" for t in ODD] + strange_texts(2)
    texts += ["".join(map(chr, (random.Random(k).randrange(32, 0x250) for _ in range(20)))) for k in range(500)]
    own = wordtok.WordTokenizer(wordtok.default_path())
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def packed_right(rows, ids, window):
    """Every id in exactly one piece, sequences gapless and within the window; the padding."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return by_doc, padding


def test_packing_covers_every_id_without_padding(spark):
    tok, rng = library(wordtok.default_path()), random.Random(5)
    texts = [*ODD, *(" ".join("word" for _ in range(rng.choice([3, 50, 61, 700]))) for _ in range(60))]
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", length int").repartition(4)
    for window in (64, 4096):
        by_doc, padding = packed_right(packing.pack(docs, window=window).collect(), ids, window)
        assert padding == 0 and set(by_doc) == set(ids)
        for i, pieces in by_doc.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at
                at += length
            assert at == len(ids[i])


def test_packing_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "a b c"), (None, None)], DOCS)
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows) == 4 * 4 + 1
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_the_best_subset(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
    capacity = rng.randint(1, 80)
    best = max(s for times in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(k * t for k, t in zip(counts, times, strict=True))) <= capacity)
    chosen = packing.fill(counts, capacity)
    assert all(t <= counts[k] for k, t in chosen.items())
    assert sum(k * t for k, t in chosen.items()) == best


def test_plan_uses_every_length_once_and_stays_small():
    counts = {k: 10**9 + k for k in range(1, 64)} | {63: 3}
    patterns = packing.plan(counts, 64)
    used = {}
    for repeats, pattern in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * repeats
    assert used == counts and len(patterns) <= 2 * len(counts)
    assert packing.powers(64 + 63, 64) == [64, 32, 16, 8, 4, 2, 1] and packing.powers(0) == []


# --- fingerprints


def brute_tree(text):
    """The tree read from its description: root and [[leaves of a paragraph] of a section], by other means than the module's."""
    short = lambda data, n=16: hashlib.blake2b(data, digest_size=n).digest()
    sections, now = [], []
    for line in text.split("\n") if text else []:
        leaves, k = [], 0
        while k < len(line):
            end = k
            while end < len(line) and end - k < 64 and line[end] not in ".!?":
                end += 1
            while end < len(line) and line[end] in ".!?":
                end += 1
            leaves.append(short(line[k:end].encode()))
            k = end
        digest = short(b"p" + b"".join(leaves))
        now.append((digest, leaves))
        if not line.strip() or digest[0] % 8 == 0:
            sections, now = [*sections, now], []
    sections += [now] if now else []
    root = short(b"d" + b"".join(short(b"s" + b"".join(p for p, _ in ps)) for ps in sections))
    return root.hex(), [[[x.hex()[:8] for x in leaves] for _, leaves in ps] for ps in sections]


def brute_likeness(a, b):
    (root_a, x), (root_b, y) = brute_tree(a), brute_tree(b)
    x, y = ([leaf for ps in side for p in ps for leaf in p] for side in (x, y))
    n, common = len(x) + len(y), sum((Counter(x) & Counter(y)).values())
    return 1.0 if root_a == root_b else min(2 * common / n, 1 - 1 / (n + 1)) if n else 0.0


def test_fingerprints_equal_brute_force(spark):
    texts = dict(enumerate([t or "" for t in ODD] + ["Same text. Twice.", "Same text. Twice.", "One.\n\nTwo. Three!\nFour"]))
    docs = spark.createDataFrame([(i, None if i == 0 else t, "x") for i, t in texts.items()], DOCS + ", fingerprint string").repartition(3)
    rows = fingerprint.compare_with_next(docs).collect()
    order = sorted(texts, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        own, other = texts[r.doc_id], texts[after[r.doc_id]]
        edited = own[: len(own) - len(own) // 3] + other[: len(own) // 3]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for spelled, text in ((r.fingerprint, own), (r.edited_fingerprint, edited)):
            root, sections = fingerprint.read(spelled)
            assert (root, [[leaves for _, leaves in ps] for _, ps in sections]) == brute_tree(text)
        assert r.near_edited == pytest.approx(brute_likeness(own, edited), abs=1e-12) and r.near_next == pytest.approx(brute_likeness(own, other), abs=1e-12)
        assert (r.edits == "") == (own == edited)


@pytest.mark.parametrize("seed", range(20))
def test_edits_are_located_each(seed):
    """Leaves outside the located ranges are the same on both sides, and ranges do not run over what stayed between two edits."""
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randint(0, 9) if seed % 2 else rng.random()} x." for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 60))]
    edited = list(lines)
    for _ in range(rng.randint(0, 4)):
        k = rng.randint(0, len(edited))
        edited[k : k + rng.randint(0, 2)] = ["Something else. And more."] * rng.randint(0, 2)
    a, b = ("\n".join(x) for x in (lines, edited))
    x, y = ([leaf for ps in brute_tree(t)[1] for p in ps for leaf in p] for t in (a, b))
    found = fingerprint.locate_edits(fingerprint.fingerprint(a), fingerprint.fingerprint(b))
    i = j = 0
    for (p, q), (r, s) in [*found, ((len(x), len(x)), (len(y), len(y)))]:
        assert x[i:p] == y[j:r] and p <= q and r <= s
        i, j = q, s
    assert fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) == pytest.approx(brute_likeness(a, b), abs=1e-12)


def test_fingerprint_edge_tables(spark):
    assert fingerprint.compare_with_next(spark.createDataFrame([], DOCS)).collect() == []
    (r,) = fingerprint.compare_with_next(spark.createDataFrame([(4, "only one text here")], DOCS)).collect()
    assert r.near_next == 1.0
    rows = fingerprint.compare_with_next(spark.createDataFrame([(4, "a"), (4, "a"), (None, "b"), (None, None)], DOCS)).collect()
    assert len(rows) == 4


def test_likeness_and_edits():
    text = "\n".join(f"Paragraph {k} begins. It goes on for a while! Does it end?" for k in range(60))
    edited = text.replace("Paragraph 30 begins", "Paragraph thirty starts")
    a, b = fingerprint.fingerprint(text), fingerprint.fingerprint(edited)
    assert a == fingerprint.fingerprint(text) and a[:32] != b[:32]
    assert 0.95 < fingerprint.likeness(a, b) < 1 and fingerprint.likeness(a, a) == 1
    assert fingerprint.likeness(a, fingerprint.fingerprint("")) == 0
    ((x, y),) = fingerprint.locate_edits(a, b)
    assert x == y == (90, 91) and fingerprint.locate_edits(a, a) == []
    twice = fingerprint.fingerprint(edited.replace("Paragraph 5 begins", "Paragraph five starts").replace("\nParagraph 50 begins. It goes on for a while! Does it end?", ""))
    assert fingerprint.locate_edits(a, twice) == [((15, 16), (15, 16)), ((90, 91), (90, 91)), ((150, 153), (150, 150))]
    moved = fingerprint.fingerprint("\n".join(reversed(text.split("\n"))))
    assert fingerprint.likeness(a, moved) < 1


# --- quality


def brute_quality(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + d for v in seen.values() if len(v) > 1 for k in v for d in range(3)}
    own = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered), failed


def test_quality_figures_equal_brute_force(spark):
    rng = random.Random(8)
    texts = ODD + [rng.choice([" ", "\n", "\t "]).join(rng.choice("a b c d e | #x é".split()) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    rows = quality.judge_quality(spark.createDataFrame([(i, t, None, 7) for i, t in enumerate(texts)], DOCS + ", source string, kept int"), keep=["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), r.doc_id


def test_bad_hosts_are_rejected_whole(spark, monkeypatch):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(i, good if i % 20 else "bad", "mixed") for i in range(100)] + [(100 + i, "bad" if i < 95 else good, "rotten") for i in range(100)] + [(300, good, None), (300, good, None), (301, good, "tiny")]
    docs = spark.createDataFrame(rows, DOCS + ", source string")
    kept = sorted(r.doc_id for r in quality.judge_quality(docs).filter("kept").collect())
    assert kept == sorted([i for i in range(100) if i % 20] + [300, 300, 301])
    assert quality.judge_quality(spark.createDataFrame([], DOCS + ", source string")).collect() == []
    assert quality.beta_prior(1, None, None)[0] > 0 and quality.beta_prior(3, 0.2, 0.01) == pytest.approx((0.2 * 15, 0.8 * 15))


def test_quality_keeps_columns_of_any_name(spark):
    names = ["_bad", "_text", "_flag", "_host", "_bad_", "_figures_", "a.b"]
    docs = spark.createDataFrame([(k, "word " * 60, "s", *range(7)) for k in range(3)], DOCS + ", source string, " + ", ".join(f"`{n}` int" for n in names))
    for r in quality.judge_quality(docs).collect():
        assert [r[n] for n in names] == list(range(7)) and r.base_failed and not r.kept
    assert {"text", "_host", "_bad"} <= set(quality.judge_quality(docs, keep=docs.columns).columns)


def brute_hosts(rows):
    """Rejected hosts of (host, failed): a beta prior by moments of the hosts' rates, its weight held to 1 to 10,000 documents."""
    hosts = {}
    for host, failed in rows:
        hosts.setdefault(host, []).append(failed)
    rates = [sum(v) / len(v) for v in hosts.values()]
    m = min(max(sum(rates) / len(rates), 1e-6), 1 - 1e-6)
    v = sum((x - sum(rates) / len(rates)) ** 2 for x in rates) / (len(rates) - 1) if len(rates) > 1 else 0
    weight = min(max(m * (1 - m) / v - 1, 1), 10_000) if v > 0 else 10_000
    return {h: (sum(x) + m * weight) / (len(x) + weight) for h, x in hosts.items()}


@pytest.mark.parametrize("seed", range(4))
def test_host_verdicts_equal_an_independent_prior(spark, seed):
    """Hosts on both sides of the limit, of one document and of hundreds, one near it whose verdict the prior turns."""
    rng, good = random.Random(seed), " ".join(f"word{k}" for k in range(60))
    hosts = {f"h{k}": (rng.choice([1, 2, 5, 40, 300]), rng.choice([0, 0.1, 0.3, 0.5, 0.6, 0.9, 1])) for k in range(25)} | {"turned": (2, 0.5), None: (3, 1)}
    rows = [(h, rng.random() < share if n > 5 else k < share * n) for h, (n, share) in hosts.items() for k in range(n)]
    rows += [("tiny bad", True)]
    docs = spark.createDataFrame([(i, "bad" if failed else good, h) for i, (h, failed) in enumerate(rows)], DOCS + ", source string").repartition(3)
    rates = brute_hosts(rows)
    judged = quality.base_rules(docs).select("doc_id", "source", "base_failed")
    found = {r.host: r for r in quality.host_rates(judged).collect()}
    assert found.keys() == rates.keys() and all(found[h].rate == pytest.approx(x, rel=1e-9) for h, x in rates.items())
    kept = {r.doc_id for r in quality.judge_quality(docs).filter("kept").collect()}
    assert kept == {i for i, (h, failed) in enumerate(rows) if not failed and rates[h] <= quality.MAX_HOST_RATE}
    assert any(x > quality.MAX_HOST_RATE for x in rates.values()) and any(x <= quality.MAX_HOST_RATE for x in rates.values())


# --- language ID


def language_rows(n=240, seed=11):
    rng = random.Random(seed)
    words = {"en": "the and of to in that with for this from".split(), "de": "der und die nicht mit ein von auf für über".split(), "fr": "le et de à la dans pour avec être où".split(), "es": "el y de la que por con para más años".split()}
    return [(i, " ".join(rng.choice(words[v]) for _ in range(rng.randint(8, 60))), v) for i in range(n) for v in [rng.choice(list(words))]]


def test_languages_are_told_apart(spark):
    rows = language_rows()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], DOCS + ", lang string, score double")
    told = {r.doc_id: r for r in langid.identify(docs).collect()}
    right = [told[i].lang_pred == v for i, _, v in rows if told[i].held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in told.values())
    assert all(told[i].held_out == (crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)


def test_predictions_need_neither_label_nor_neighbours(spark):
    rows = language_rows()
    model = langid.train(spark.createDataFrame(rows, DOCS + ", lang string"))
    alone = {i: langid.predict(spark.createDataFrame([(i, t)], DOCS), model).first() for i, t, _ in rows[:4]}
    together = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS).coalesce(1), model).collect()}
    for i, r in alone.items():
        assert r.lang_pred == together[i].lang_pred and r.score == pytest.approx(together[i].score, abs=1e-5)


@pytest.mark.parametrize("key", [None, 7])
def test_language_sample_holds_where_keys_repeat(spark, monkeypatch, key):
    rows = [(key, f"the and of {k}", "en") for k in range(2000)]
    seen = []
    monkeypatch.setattr(langid, "fit", lambda spark, langs, rows: seen.append(len(langs)))
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200)
    assert seen == [200]


def test_two_hundred_labels_take_bounded_memory(spark):
    """Free labels: the driver holds TOTAL sparse rows, machines are fitted in tasks, and labels without a known family get one."""
    rng = random.Random(3)
    letters = [[rng.choice("abcdefghijklmnopqrstuvwxyzäöüéèñçøåßþ") for _ in range(6)] for _ in range(40)]
    words = [["".join(rng.choice(letters[k // 5]) for _ in range(rng.randint(2, 7))) for _ in range(30)] for k in range(200)]
    rows = [(i, " ".join(rng.choice(words[i % 200]) for _ in range(40)), "" if i % 200 == 7 else f"x{i % 200}") for i in range(6000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model = langid.train(spark.createDataFrame(rows, DOCS + ", lang string"), total=1000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB
    assert sorted(model.root.langs) == sorted({v for *_, v in rows}) and "" in model.root.langs
    assert all(len(n.children) <= langid.FAN for n in model.root.below()) and all(n.children or len(n.langs) <= langid.CLOSE for n in model.root.below())
    told = langid.predict(spark.createDataFrame([(i, t) for i, t, _ in rows[:400]], DOCS), model).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in told) > 300


def test_five_hundred_labels_of_one_alphabet_take_bounded_memory_and_machines(spark):
    """One alphabet makes one family: it is cut again, so that machines grow with the labels and not with their square."""
    rng = random.Random(5)
    words = [["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(25)] for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words[i % 500]) for _ in range(60)), f"y{i % 500}") for i in range(5000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model = langid.train(spark.createDataFrame(rows, DOCS + ", lang string"))
    told = langid.predict(spark.createDataFrame([(i, t) for i, t, _ in rows[:1000]], DOCS), model).collect()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kB
    assert len(model.root.langs) == 500 and len(model.weights) < 500 * 5
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in told) > 700


def test_labels_beyond_the_total_are_left_out_and_no_label_of_few_rows_is_missed(spark):
    rows = [(i, f"{'abcdefghij'[i % 10] * 5} word", f"z{i % 10}" if i < 40 else "z0") for i in range(400)]
    model = langid.train(spark.createDataFrame(rows, DOCS + ", lang string"))
    assert len(model.root.langs) == 10
    few = langid.train(spark.createDataFrame(rows, DOCS + ", lang string"), total=4)
    assert few is None or 1 <= len(few.root.langs) <= 4


def brute_machine(x, y):
    """The same squared hinge loss by plain gradient steps in float64."""
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):
        gap = np.maximum(0, 1 - y * (x @ w + b)) * y * weight
        w, b = w - 0.1 * (langid.PENALTY * w - 2 * x.T @ gap), b + 0.1 * 2 * gap.sum()
    return w, b


def test_a_machine_against_plain_gradient_steps():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) / 3
    y = np.where(x @ [1, -2, 0.5, 0, 1] + rng.normal(size=60) / 5 > 0, 1.0, -1.0)
    w, b = langid.svm(x, y)
    v, c = brute_machine(x, y)
    loss = lambda w, b: (langid.PENALTY / 2 * w @ w + (np.maximum(0, 1 - y * (x @ w + b)) ** 2 * np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())).sum())
    assert loss(w, b) <= loss(v, c) + 1e-3 and np.mean(np.sign(x @ w + b) == np.sign(x @ v + c)) == 1


def brute_features(text):
    data = bytes(langid.CLASSES[b] for b in text.encode())
    counts = np.zeros(langid.BUCKETS)
    for n in (1, 2, 3):
        for at in range(n - 1, len(data)):
            if data[at] != 32:
                code = (int.from_bytes(data[at - n + 1 : at + 1], "little") + n) * 0x9E3779B97F4A7C15 % (1 << 64)
                counts[code >> (64 - langid.BITS)] += 1
    counts[0] = 0
    return counts / max(counts.sum(), 1)


def test_features_against_counting_one_by_one(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 37)
    monkeypatch.setattr(langid, "TEXTS", 3)
    texts = ["The cat, ñandú", "", "x", "12 34", "ab " * 40, "日本", "z" * 100]
    data = "".join(texts).encode()
    ends = np.cumsum([0] + [len(t.encode()) for t in texts])
    rows = np.concatenate([x for _, x in langid.features(np.frombuffer(data, np.uint8), ends)])
    assert np.allclose(rows, [brute_features(t) for t in texts], atol=1e-6)


def test_language_edge_cases(spark):
    rows = language_rows(60) + [(900, None, "en"), (901, "", None), (902, "123 ... !", "xx"), (903, "the and of " * 20_000, None)]
    told = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS + ", lang string")).collect()}
    assert [told[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and told[902].score == 0
    assert told[903].lang_pred == "en"
    assert {r.lang_pred for r in told.values()} <= {"en", "de", "fr", "es", "und"}
    unlabelled = spark.createDataFrame([(1, "text", None)], DOCS + ", lang string")
    assert langid.identify(unlabelled).first().lang_pred == "und"
    assert langid.identify(spark.createDataFrame([], DOCS + ", lang string")).collect() == []


# --- URL filters

URLS = [
    None, "", "no host", "http://", "http://EXAMPLE.com/en/7", "http://a.example.com/en/71?x=/net/", "https://other.com/en/7", "http://com/en/", "http://xcom/en/", "http://x.net/de/8", "http://example.net/de/8#a",
    "http://example.net/de/", "http://sub.example.net/de/89/", "ftp://x.org/es/", "http://x.org/es", "http://x.org?/es/", "http://a.b://c.org/es/", "http://É.org/es/" + "x" * 50_000, "http://exampleXcom/en/7",
]


def brute_url(url, rules):
    _, there, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest)[0] if there else ""
    path = re.match("[^?#]*", rest[len(host) :])[0] if there else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if url_filter.matches(r, host, path)]
    best = min(fits, key=lambda r: (-len(r.text), r.text, r.verdict), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.mark.parametrize("inline", [256, 0])
def test_url_verdicts_equal_brute_force(spark, inline):
    rng = random.Random(2)
    hosts = ["com", "example.com", "a.example.com", "net", "", "example.net", "a-b.org"]
    more = [url_filter.Rule(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/", "/en/", "/en", "/en/7", "/a.b/", "/(x)/"])) for _ in range(40)]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/77', '/a.b/c', '/(x)/y', '/axb/'])}" for _ in range(200)]
    for rules in (url_filter.RULES, more):
        pages = spark.createDataFrame([(i, u, "own", i) for i, u in enumerate(urls)], "page_id long, url string, rule string, best long")
        assert all(r.best == r.page_id for r in url_filter.filter_urls(pages, rules, inline_rules=inline).collect())
        found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, inline_rules=inline).collect()}
        assert found == {i: brute_url(u, rules) for i, u in enumerate(urls)}


def test_url_repeated_rows_empty_tables_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.org/es/")] * 3, "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, url_filter.RULES).collect()] == ["block"] * 3
    assert [r.verdict for r in url_filter.filter_urls(pages, []).collect()] == ["allow"] * 3
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).collect() == []
    assert url_filter.index_rules(url_filter.RULES).keys() == {"p:es", "p:en", "p:de"} or len(url_filter.index_rules(url_filter.RULES)) >= 3
