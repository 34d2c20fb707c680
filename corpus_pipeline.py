"""A corpus pipeline of five stages: quality rules, language ID, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of
documents, n_chars following the text; the last returns the pieces of the packed sequences.

Defined for every stage: a null text is an empty one; an empty table gives an empty result; texts of any length are
read whole; other columns than those of documents are carried along, whatever they are called; rows are kept one for
one, repeated ones too, but where a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, langid, lines, packing, quality
from quire.llm.shared import few, materialise

#: A document is rejected by language ID if its language is unknown or less likely than this.
LEAST_SCORE = 0.3
#: Columns that the operators read by name; any other is set aside while they work.
READ = ("doc_id", "text", "lang", "source")


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with names of our own for the columns that no operator reads, and what gives a result its columns back."""
    own = [c if c in READ else f"aside_{k}_of_documents" for k, c in enumerate(docs.columns)]
    return docs.toDF(*own), lambda out: out.select(*[F.col(f"`{o}`").alias(c) for o, c in zip(own, docs.columns, strict=True)])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or whose host is rejected go.

    A null text fails the base rules, as it has no words; rows of a null source are a host of their own. Repeated rows
    each count for their host.
    """
    own, back = set_aside(docs)
    return back(quality.judge_quality(own, keep=own.columns).filter("kept"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language, or with an unlikely one, go.

    A text that is null or has no letter goes; without any labelled text with a letter all go. The label of a row is
    never read for its own prediction where the row is held out, so a null label changes nothing there.
    """
    own, back = set_aside(docs)
    judged = langid.identify(own)
    return back(judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that many documents share go; documents stay, even if nothing of them is left.

    A null text comes back empty. Rows of one doc_id (null too) count as one document for a line. n_chars is the
    number of code points that are left.
    """
    own, back = set_aside(docs)
    cleaned = back(lines.dedup_lines(own))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of linked documents the one with the smallest doc_id stays; without words all stay.

    Where doc_ids repeat, each different text of a doc_id is a document of its own: rows with one doc_id and one text
    stay once, and a text goes only if a text that it is linked with stays. Rows of a null doc_id are linked with
    nothing and stay. Of linked texts of one doc_id one stays, whichever.
    """
    named = docs.filter("doc_id IS NOT NULL")
    if not named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        linked = materialise(jaccard.link_documents(docs.select("doc_id", "text")), "linked")
        gone = materialise(linked.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
        return docs.join(F.broadcast(gone) if few(gone) else gone, "doc_id", "left_anti").select(*docs.columns)
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    told = named.select("doc_id", "text", text.alias("sha"))
    rows = materialise(told.select("doc_id", "sha").distinct().withColumn("row", F.monotonically_increasing_id()), "rows")
    texts = told.dropDuplicates(["doc_id", "sha"]).join(rows, ["doc_id", "sha"])
    linked = materialise(jaccard.link_documents(texts.select(F.col("row").alias("doc_id"), "text")), "linked")
    placed = linked.select(F.col("doc_id").alias("row"), "component_id").join(rows, "row")
    stay = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "row", "sha")).alias("s")).select(F.col("s.doc_id").alias("id_that_stays"), F.col("s.sha").alias("sha_that_stays"))
    own, back = set_aside(named)
    once = own.withColumn("sha_of_text", text).dropDuplicates(["doc_id", "sha_of_text"])
    kept = back(once.join(stay, (F.col("doc_id") == F.col("id_that_stays")) & (F.col("sha_of_text") == F.col("sha_that_stays")), "left_semi"))
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every document's tokens in sequences of at most 4096.

    An empty or null text is a piece of its end token alone. Rows of a null or repeated doc_id are packed each on its
    own. Other columns are left out.
    """
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", keep_good),
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("packing", pack),
]

#: Language ID is learned, and the token ids are the tokenizer's: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
