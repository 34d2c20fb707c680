"""Every operator over tables with extra columns whose names clash with its own, in upper case."""

import pytest
from pyspark.sql import functions as F

from quire.llm import audit, bpe, chat, exact, fingerprint, jaccard, langid, lines, manifest, packing, quality, url_filter, warc

EXTRA = {
    "packing": ["START", "LENGTH", "IDS", "SEQUENCE_ID", "OFFSET", "PIECE"],
    "fingerprint": ["FINGERPRINT", "N_CHARS", "EDITS", "NEAR_NEXT"],
    "jaccard": ["N_SHINGLES", "COMPONENT_ID", "TOKEN", "HOST"],
    "langid": ["HELD_OUT", "LANG_PRED", "SCORE"],
    "quality": ["N_WORDS", "KEPT", "BASE_FAILED", "RATE"],
    "lines": ["N_LINES", "N_DROPPED", "KEY", "SHARD"],
    "bpe": ["IDS", "N_TOKENS", "DECODED"],
    "exact": ["KEEP_ID", "GROUP_SIZE", "KEPT", "CONTENT_SHA256", "H"],
    "audit": ["PART", "MASK", "N"],
}


def docs(spark, name):
    rows = [(1, "one two three four five six\nsame", "en", "s"), (2, "one two three four five six\nsame", "en", None), (3, None, None, "s"), (4, "uno dos tres " * 30, "es", "s")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.withColumns({c: F.lit("own") for c in EXTRA[name]})


@pytest.mark.parametrize("name", sorted(EXTRA))
def test_documents(spark, name):
    d = docs(spark, name)
    labels = spark.createDataFrame([(1, 1, 0)], "DOC_ID long, QUALITY int, TOXIC int")
    run = {
        "packing": lambda: packing.pack(d), "fingerprint": lambda: fingerprint.compare_with_next(d), "jaccard": lambda: jaccard.link_documents(d), "langid": lambda: langid.identify(d),
        "quality": lambda: quality.judge_quality(d), "lines": lambda: lines.dedup_lines(d), "bpe": lambda: bpe.decode(bpe.encode(d)), "exact": lambda: exact.find_copies(d, keep=d.columns),
        "audit": lambda: audit.audit(d, labels),
    }[name]()
    names = [c.lower() for c in run.columns]
    assert len(set(names)) == len(names) and run.count() > 0
    added = [c for c in run.columns if c not in EXTRA[name]]
    if name != "audit":
        assert "own" not in {v for r in run.select(*added).collect() for v in r}


def test_urls_chats_archives_and_manifest(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com/en/", "<p>"), (2, None, None)], "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("HOST", "PATH", "RULE", "VERDICT", "RECORD_TYPE", "DIGEST")})
    judged = url_filter.filter_urls(pages, url_filter.RULES)
    assert {tuple(r) for r in judged.select("page_id", "host", "rule").collect()} == {(1, "a.com", "com/en/"), (2, "", None)}
    many = [url_filter.parse_rule("block", f"h{k}.com/") for k in range(5)]
    assert url_filter.filter_urls(pages, many, inline_rules=2).filter("verdict = 'allow'").count() == 2
    warc.write_archives(pages, str(tmp_path / "warc"))
    assert warc.read_archives(spark, str(tmp_path / "warc")).count() == 2
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string").withColumns({c: F.lit("own") for c in ("COST", "RANK", "CHUNK", "SALT")})
    assert chat.format_chats(turns).count() == 1
    rows = docs(spark, "exact").withColumn("leaf", manifest.leaf(F.col("doc_id"))).withColumns({c: F.lit("own") for c in ("PROOF", "ROOT", "SUBROOT", "PLACE")})
    assert manifest.Manifest(rows, "lang", "doc_id", "leaf", keep=rows.columns).proofs().filter("verified").count() == 4
