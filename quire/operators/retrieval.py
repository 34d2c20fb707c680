"""Bounded full-text retrieval over blocks, unit search, and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import occurrences, query_terms

EXCERPT, BEFORE = 1400, 100


def holding(units: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The units whose text holds all terms of the query: a block that does lies in such a unit, so the others need not be cut into blocks."""
    for term in query_terms(query):
        units = units.filter(F.contains(F.lower(text), F.lit(term)))
    return units


def intact_documents(blocks: DataFrame, integrity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of documents whose artifacts are whole (integrity: doc_id, integrity_ok), and the doc_ids of the others, which a consult lists apart."""
    whole = integrity.groupBy("doc_id").agg(F.bool_and(F.coalesce("integrity_ok", F.lit(False))).alias("ok"))
    return blocks.join(whole.filter("ok").select("doc_id"), "doc_id", "left_semi"), whole.filter("NOT ok").select("doc_id")


def ranked(blocks: DataFrame, query: str, limit: int) -> DataFrame:
    """The best blocks that hold all terms of the query, and one more if there are more; a top-k, no full sort.

    score: 100 for the query as it stands, and the number of times each term occurs.
    Ties go by doc_id, unit and block_id (as text).
    """
    terms, lower = query_terms(query), F.lower("text")
    if not terms:
        raise ValueError("the query has no letters or digits")
    if not 1 <= limit <= 20:
        raise ValueError("limit must be 1 to 20")
    score = F.when(F.contains(lower, F.lit(query.lower())), 100).otherwise(0).cast("long")
    for term in terms:
        score = score + occurrences(lower, term)
    held = holding(blocks, query)
    order = [F.desc("score"), "doc_id", "unit", "block_id"]
    return held.select("doc_id", "unit", "block_id", score.alias("score"), "text").orderBy(*order).limit(limit + 1)


def consult(blocks: DataFrame, query: str, limit: int = 5, max_chars: int = 4000) -> DataFrame:
    """rank, doc_id, unit, block_id, excerpt, excerpt_truncated: the hits that the character budget allows."""
    if not 200 <= max_chars <= 20_000:
        raise ValueError("max_chars must be 200 to 20000")
    best, terms, lower = ranked(blocks, query, limit), query_terms(query), F.lower("text")
    first = F.least(*[F.when(F.locate(t, lower) > 0, F.locate(t, lower) - 1) for t in terms], F.lit(1 << 30))
    first = F.when(first == 1 << 30, 0).otherwise(first)
    top = best.withColumn("first", first.cast("int"))
    hits = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "doc_id", "unit", "block_id", "text", "first"))).alias("hits"))

    def step(s, h):
        allowance = F.least(s["left"], F.lit(EXCERPT))
        start = F.when(F.length(h["text"]) > allowance, F.greatest(h["first"] - BEFORE, F.lit(0))).otherwise(0)
        excerpt = F.substring(h["text"], start + 1, allowance)
        cut = (start > 0) | (start + F.length(excerpt) < F.length(h["text"]))
        hit = F.struct(h["doc_id"].alias("doc_id"), h["unit"].alias("unit"), h["block_id"].alias("block_id"), excerpt.alias("excerpt"), cut.alias("excerpt_truncated"))
        more = F.struct((s["left"] - F.length(excerpt)).alias("left"), F.array_append(s["out"], hit).alias("out"))
        return F.when((s["left"] <= 0) | (F.size(s["out"]) >= limit), s).otherwise(more)

    kind = dict(blocks.dtypes)
    empty = F.array().cast(f"array<struct<doc_id:{kind['doc_id']},unit:{kind['unit']},block_id:string,excerpt:string,excerpt_truncated:boolean>>")
    folded = hits.select(F.aggregate("hits", F.struct(F.lit(max_chars).alias("left"), empty.alias("out")), step, lambda s: s["out"]).alias("out"))
    return folded.select(F.posexplode("out").alias("pos", "h")).select((F.col("pos") + 1).alias("rank"), "h.*")


def search_units(blocks: DataFrame, query: str) -> DataFrame:
    """doc_id and the sorted units whose whole text holds the query, whatever the case."""
    whole = blocks.groupBy("doc_id", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), "").alias("text"))
    return whole.filter(F.contains(F.lower("text"), F.lit(query.lower()))).groupBy("doc_id").agg(F.array_sort(F.collect_set("unit")).alias("units"))


def library_report(catalog: DataFrame, intact: DataFrame, kinds: DataFrame, blocks: DataFrame | None = None, query: str | None = None) -> DataFrame:
    """The library by title and doc_id: doc_id, title, status, integrity_ok, kind and, with a query, the units that hold it.

    catalog: doc_id, title, status; intact: doc_id, integrity_ok; kinds: doc_id, input_kind. A package of which nothing
    is known is not intact, and only an intact one tells its kind. With a query (and blocks: doc_id, unit, block_no,
    text) intact packages with a hit remain; it is neither cut into words nor ranked, and nothing is left out.
    """
    rows = catalog.join(intact.groupBy("doc_id").agg(F.bool_and("integrity_ok").alias("integrity_ok")), "doc_id", "left").join(kinds.groupBy("doc_id").agg(F.min("input_kind").alias("input_kind")), "doc_id", "left")
    fine = F.coalesce("integrity_ok", F.lit(False))
    told = rows.select("doc_id", "title", "status", fine.alias("integrity_ok"), F.when(fine, F.coalesce("input_kind", F.lit(""))).otherwise("").alias("kind"))
    if query is not None:
        whole = blocks.join(told.filter("integrity_ok").select("doc_id"), "doc_id", "left_semi")
        told = told.filter("integrity_ok").join(search_units(whole, query), "doc_id")
    return told.orderBy("title", "doc_id")


def rerank(hits: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """hits (local_rank, ...) by their scores (local_rank, score) falling, those without one last, then as they stood."""
    return hits.join(scores, "local_rank", "left").orderBy(F.desc_nulls_last("score"), "local_rank").limit(limit)
