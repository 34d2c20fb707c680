"""The contract queries over the test tables: each a thin reading of its operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, exact, fingerprint, jaccard, langid, lines, manifest, oracles, packing, quality, url_filter, warc
from .shared import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge_quality(docs, keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, drop=("text",)).select("doc_id", "held_out", "lang_pred", "score")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, keep_text=False))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.find_copies(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("content_sha256").alias("text_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    own = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = [F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in own]
    rows = docs.select("doc_id", "lang", manifest.leaf(*map(F.col, own)).alias("leaf"), F.when(changed, manifest.leaf(*tampered)).alias("claimed"))
    proofs = manifest.Manifest(rows, "lang", "doc_id", "leaf", "claimed", keep=["doc_id"]).proofs()
    siblings = F.concat_ws("", F.zip_with("before", "behind", lambda a, b: F.concat(a, b)))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_fingerprint": op2_fingerprint,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_url_filter": op4_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op5_language_id": op5_language_id,
    "op7_chat_format": op7_chat_format,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {
    "op3_jaccard_join": oracles.OP3,
    "op4_url_filter": oracles.OP4,
    "op6_quality_rules": oracles.OP6,
    "op7_chat_format": oracles.OP7,
    "op8_warc": oracles.OP8,
    "op9_line_dedup": oracles.OP9,
    "op11_exact_dedup": oracles.OP11,
    "op12_filter_audit": oracles.OP12,
    "op13_merkle_manifest": oracles.OP13,
}
