"""The contract of a document: what must hold before it may be published, told rule by rule and as one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.documents import KINDS, unit_flags
from quire.operators.ranges import dealt_to, shuffled, tasks_for

#: The contract's version, and the ranks that a heading may have.
VERSION, RANKS = 1, (1, 6)


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, "(?U)\\s+", "")) == "", F.lit(True))


def contract_faults(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, rule, unit (null for the document's own), n: how often each rule is broken.

    documents: doc_id, schema_version, title, expected (array of units), missing_images (array of units that were
    asked for as images and have none). blocks: doc_id, unit, entry (the number of the unit's entry in its document,
    as a unit may be delivered twice), pos, block_id, kind, level, text; an entry without blocks is one row without
    kind, id and text. A level counts only where it is told.

    Rules: version, title, scope (empty or below 1), scope_repeated, unit (not expected, or delivered again), empty
    (an entry without text), block (no id, an id that an earlier block has, an unknown kind), level, missing, image.
    """
    expected = F.coalesce("expected", F.array().cast("array<int>"))
    own = {
        "version": ~F.col("schema_version").eqNullSafe(F.lit(VERSION)),
        "title": _blank(F.col("title")),
        "scope": (F.size(expected) == 0) | F.exists(expected, lambda n: n.isNull() | (n < 1)),
        "scope_repeated": F.size(F.array_distinct(expected)) < F.size(expected),
    }
    none = F.lit(None).cast("int").alias("unit")
    of_document = documents.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(broken, rule) for rule, broken in own.items()]))).alias("rule"), none, F.lit(1).cast("long").alias("n"))

    # Adaptive execution would merge these narrow rows by compressed bytes, however many a task gets.
    tasks = tasks_for(blocks.count())
    asked = documents.select("doc_id", F.explode(F.array_distinct(expected)).alias("unit")).withColumn("asked", F.lit(True))
    entries = dealt_to(blocks, tasks, "doc_id", "unit").groupBy("doc_id", "unit", "entry").agg(F.bool_and(_blank(F.col("text"))).alias("blank"))
    per_unit = entries.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("entries"), F.count_if("blank").alias("empty"))
    both = per_unit.join(shuffled(asked), ["doc_id", "unit"], "full_outer")
    unexpected = F.coalesce(F.when(F.col("asked"), F.col("entries") - 1).otherwise(F.col("entries")), F.lit(0))
    told = F.array(*[F.struct(F.lit(rule).alias("rule"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for rule, n in (("unit", unexpected), ("empty", F.col("empty")), ("missing", F.col("entries").isNull().cast("int")))])
    of_units = both.select("doc_id", "unit", F.inline(told)).filter("n > 0")

    # Blocks that share an id are few: a window over one id of one document.
    seen = F.row_number().over(Window.partitionBy("doc_id", "block_id").orderBy("entry", "pos"))
    real = blocks.filter("block_id IS NOT NULL OR kind IS NOT NULL OR text IS NOT NULL")
    real = dealt_to(real, tasks, "doc_id", "block_id").withColumn("nth", seen)
    bad = (F.coalesce("block_id", F.lit("")) == "") | (F.col("nth") > 1) | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    off = (F.col("kind") == "heading") & F.col("level").isNotNull() & ~F.col("level").between(*RANKS)
    rules = F.array_compact(F.array(F.when(bad, "block"), F.when(off, "level")))
    of_blocks = dealt_to(real.select("doc_id", "unit", F.explode(rules).alias("rule")), tasks, "doc_id", "unit").groupBy("doc_id", "rule", "unit").agg(F.count(F.lit(1)).alias("n"))
    images = documents.select("doc_id", F.lit("image").alias("rule"), F.explode("missing_images").alias("unit")).groupBy("doc_id", "rule", "unit").agg(F.count(F.lit(1)).alias("n"))
    columns = ["doc_id", "rule", "unit", "n"]
    return of_document.select(*columns).unionByName(of_units.select(*columns)).unionByName(of_blocks.select(*columns)).unionByName(images)


def contract_verdict(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, status, errors and warnings of each document: sorted lists of `rule` or `rule unit`, repeated as often as broken.

    A document with an error is `parcial`; no import makes itself more than `revisar`.
    """
    named = lambda rule, unit: F.concat_ws(" ", rule, unit.cast("string"))
    faults = contract_faults(documents, blocks).select("doc_id", F.explode(F.array_repeat(named(F.col("rule"), F.col("unit")), F.col("n").cast("int"))).alias("error"))
    tasks = tasks_for(blocks.count())
    errors = dealt_to(faults, tasks, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    whole = dealt_to(blocks, tasks, "doc_id", "unit").groupBy("doc_id", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", "pos", "text"))), lambda b: F.coalesce(b["text"], F.lit(""))), "").alias("text"))
    flags = unit_flags(whole)
    marks = F.array_compact(F.array(*[F.when(F.col(c), named(F.lit(c), F.col("unit"))) for c in ("doubt", "linked_image", "active_content")]))
    warnings = dealt_to(flags.select("doc_id", F.explode(marks).alias("warning")), tasks, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    none = F.array().cast("array<string>")
    out = dealt_to(documents.select("doc_id"), tasks, "doc_id").join(shuffled(errors), "doc_id", "left").join(shuffled(warnings), "doc_id", "left")
    out = out.select("doc_id", F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"))
    return out.select("doc_id", F.when(F.size("errors") > 0, "parcial").otherwise("revisar").alias("status"), "errors", "warnings")
