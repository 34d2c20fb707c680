"""The pipeline stage by stage against brute force on a small fixture, and the contract queries against their SQL."""

import os
import random

import pytest
from compare import differences
from pyspark.sql import functions as F
from test_pairs_and_lines import brute_components, brute_lines

import corpus_pipeline
from quire.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    words = {"en": "the and of to in that with for this from was".split(), "de": "der und die nicht mit ein von auf für über".split(), "fr": "le et de à la dans pour avec être où".split()}
    rows = []
    for i in range(90):
        lang = rng.choice(list(words))
        body = "\n".join(" ".join(rng.choice(words[lang]) + rng.choice(["", "a", "is", f"{rng.randint(0, 99)}"]) for _ in range(12)) for _ in range(7))
        rows.append((i, f"Shared header line\n{body}" if i % 3 == 0 else body, lang, f"src{i % 5}"))
    rows += [(100 + k, rows[k][1], rows[k][2], "src9") for k in range(0, 20, 4)]  # copies
    rows += [(200 + k, rows[k][1] + " tail", rows[k][2], "src9") for k in range(1, 20, 4)]  # near copies
    rows += [(300, None, "en", "src0"), (301, "", "en", "src0"), (302, "1 2 3 " * 40, None, "src0"), (303, "word " * 80, "en", "src0"), (304, "... !!! " + " ".join(f"{k}?" for k in range(90)), "en", "src0")]
    return [(i, t, v, s, len(t or "")) for i, t, v, s in rows]


def test_stages_in_turn(spark):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs.collect()
    good = {r.doc_id for r in out["quality_rules"]}
    assert not good & {300, 301, 302, 303} and {r[0] for r in corpus()} - good == {300, 301, 302, 303}
    known = {r.doc_id: r for r in out["language_id"]}
    assert set(known) == good - {304}
    cleaned = {r.doc_id: r for r in out["line_dedup"]}
    dropped = {i: n for i, _, n, _ in brute_lines([(i, r.text) for i, r in known.items()], 10)}
    assert set(cleaned) == set(known) and all(r.n_chars == len(r.text) for r in cleaned.values())
    assert all(cleaned[i].text.count("\n") == known[i].text.count("\n") - n for i, n in dropped.items()) and sum(dropped.values()) > 20
    want = {i for i, (_, c) in brute_components([(i, r.text) for i, r in cleaned.items()]).items() if i == c}
    assert {r.doc_id for r in out["jaccard_join"]} == want and not want & {100, 104, 201, 205}
    assert {r.doc_id for r in out["packing"]} == want


def test_repeated_rows_stay_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)] * 3 + [(2, "a b c d e f", "en", "s", 11), (None, "x", "en", "s", 1)], COLUMNS)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == ["1", "None"]


def test_texts_of_one_doc_id_stay(spark):
    rows = [(1, "a b c d e f", "en", "s", 11)] * 2 + [(1, "u v w x y z", "en", "s", 11), (1, "", "en", "s", 0), (2, "k l m n o p", "en", "s", 11)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, ""), (1, "a b c d e f"), (1, "u v w x y z"), (2, "k l m n o p")]


def test_a_text_is_not_lost_with_the_doc_id_that_it_shares(spark):
    a, b = "a b c d e f", "quite another text of seven words here"
    rows = [(0, a, "en", "s", 11), (1, a, "en", "s", 11), (1, b, "en", "s", 38), (2, b + " x", "de", "t", 1), (2, None, "de", "t", 0)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("SHA", F.lit(1))
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(0, a), (1, b), (2, "")] + [(2, b + " x")]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_a_stage_carries_other_columns_and_takes_nulls_long_texts_and_repeated_rows(spark, name):
    rng = random.Random(2)
    long = "\n".join(" ".join(rng.choice("the and of to in that with for this from was".split()) + str(rng.randint(0, 999)) for _ in range(12)) for _ in range(9000))
    rows = [*corpus(), (None, None, None, None, None), (400, long, "en", "src0", len(long)), (401, None, None, "src0", None)]
    rows += [rows[0]] * 2
    extra = {"KEPT": "k", "n_words": "w", "Score": "s", "N_LINES": "l", "component_id": "c", "held_out": "h"}
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(v) for c, v in extra.items()})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns
    found = out.collect()
    assert all({r[c] for r in found} == {v} for c, v in extra.items())
    assert [len(r.text) > 500_000 for r in found if r.doc_id == 400] == [True]
    times = sum(r.doc_id == 0 for r in found)
    assert times == (1 if name == "jaccard_join" else 3)


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract_query(spark, name):
    assert differences(spark, SF_DIR, name) == []
