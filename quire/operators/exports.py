"""Named exports with ownership: a file is written anew only by the source that wrote it last and if nobody has edited it since.

A plan compares three sides: the registry (which source wrote a file, with what content), the disk as it is, and the
new content. Names of one title are told apart by numbers: (2), (3) and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import safe_filename, sub

from .ranges import HOT, numbered

#: Numbers of one title.
MOST_NAMES = 999
ENDING = ".md"
NUMBER = "^(.*) \\(([1-9][0-9]{0,2})\\)$"


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: a broadcast, which Spark picks by compressed bytes, would go through the driver."""
    return side.hint("merge")


def url_path(path: Column) -> Column:
    """A path with everything escaped but letters, digits, `/` and `_.-~`."""
    out = F.url_encode(path)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def relinked(text: Column, names: Column, base: Column) -> Column:
    """text whose links to the package's own files (names) lead there from beside the export: below base."""

    def one(so_far: Column, name: Column) -> Column:
        to = F.concat(F.lit("](<"), url_path(F.concat(base, F.lit("/"), name)), F.lit(">)"))
        for old in (F.concat(F.lit("]("), name, F.lit(")")), F.concat(F.lit("](<"), name, F.lit(">)"))):
            so_far = F.replace(so_far, old, to)
        return so_far

    return F.aggregate(F.coalesce(names, F.array().cast("array<string>")), F.coalesce(text, F.lit("")), one)


def _stem(target: str) -> Column:
    return sub(F.col(target), "(?i)\\.md$", "")


def _slots(names: DataFrame) -> DataFrame:
    """key and slot that each name (stem) takes: slot 1 of its own title and, if it ends in a number, that of the title before it."""
    own = names.select(F.lower("stem").alias("key"), F.lit(1).alias("slot"), "stem")
    number = F.regexp_extract("stem", NUMBER, 2).try_cast("int")
    second = names.filter(number >= 2).select(F.lower(F.regexp_extract("stem", NUMBER, 1)).alias("key"), number.alias("slot"), "stem")
    return own.unionByName(second)


def plan_exports(documents: DataFrame, registry: DataFrame, disk: DataFrame, most: int = HOT) -> DataFrame:
    """doc_id, target, action, content, sha256: what an export of documents into a folder does.

    documents: doc_id, source_id (source and scope), title, text, names (the package's files it may link to), base (the
    package as seen from the folder), integrity_ok; registry: target, source_id, sha256; disk: target, sha256.

    damaged: the package is not intact and has no target. superseded: a later document (by doc_id) of the same source
    and title is exported in this run. unchanged: a file of this title has this content already. overwrite: this source
    wrote a file of this title last, and the disk holds what it wrote. create: the next free number; sources of
    equal content share it. full: more than MOST_NAMES numbers would be needed. The lowest number that fits is taken.
    A title that is another's with a number (`A (2)`) keeps its own: the other's second number counts as taken.
    Names are compared in lower case; a null title or text is empty.
    """
    d = documents.withColumn("stem", safe_filename(F.coalesce("title", F.lit(""))))
    d = d.withColumns({"key": F.lower("stem"), "content": relinked(F.col("text"), F.col("names"), F.col("base"))})
    d = d.select("doc_id", "source_id", "stem", "key", "content", F.sha2("content", 256).alias("sha256"), F.coalesce("integrity_ok", F.lit(False)).alias("fine"))
    fine = d.filter("fine")
    last = fine.groupBy("key", "source_id").agg(F.max("doc_id").alias("last"), F.min("doc_id").alias("first"))
    d = d.join(_shuffled(last.withColumnsRenamed({"key": "k_", "source_id": "s_"})), (F.col("key") == F.col("k_")) & F.col("source_id").eqNullSafe(F.col("s_")), "left").drop("k_", "s_")
    asking = d.filter("fine AND doc_id = last")

    there = disk.select(_stem("target").alias("stem"), F.col("sha256").alias("held"), F.lower("target").alias("path"))
    mine = registry.select(F.lower("target").alias("path"), F.col("source_id").alias("owner"), F.col("sha256").alias("wrote"))
    held = _slots(there).join(_shuffled(there), "stem").join(_shuffled(mine), "path", "left").filter(f"slot <= {MOST_NAMES}")
    near = asking.join(_shuffled(held.select("key", "slot", "held", "owner", "wrote", F.col("stem").alias("stem_there"))), "key")
    equal, owned = F.col("held") == F.col("sha256"), F.col("owner").eqNullSafe(F.col("source_id")) & (F.col("wrote") == F.col("held"))
    found = near.filter(equal | owned).groupBy("doc_id").agg(F.min(F.struct("slot", (~equal).alias("writes"), "stem_there")).alias("f"))
    met = asking.join(_shuffled(found), "doc_id", "left")

    reserved = _slots(asking.select("stem").distinct()).filter("slot > 1").select("key", "slot")
    taken = held.select("key", "slot").unionByName(reserved).groupBy("key").agg(F.array_sort(F.collect_set("slot")).alias("taken"))
    new = met.filter("f IS NULL").groupBy("key", "sha256").agg(F.min("first").alias("first"))
    ranked = numbered(new, "key", ["first", "sha256"], "rank", most).join(_shuffled(taken), "key", "left")
    slot = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("rank").cast("int"), lambda at, t: F.when(t <= at, at + 1).otherwise(at))
    met = met.join(_shuffled(ranked.select("key", "sha256", slot.alias("slot"))), ["key", "sha256"], "left")

    action = F.when(F.col("f").isNotNull(), F.when(F.col("f.writes"), "overwrite").otherwise("unchanged")).when(F.col("slot") > MOST_NAMES, "full").otherwise("create")
    name = F.when(F.col("slot") > 1, F.concat("stem", F.lit(" ("), F.col("slot").cast("string"), F.lit(")"))).otherwise(F.col("stem"))
    target = F.when(action != "full", F.concat(F.coalesce("f.stem_there", name), F.lit(ENDING)))
    told = met.select("doc_id", "source_id", target.alias("target"), action.alias("action"), "content", "sha256")
    none = lambda c: F.lit(None).cast("string").alias(c)
    rest = d.filter("NOT fine OR doc_id <> last").select("doc_id", "source_id", none("target"), F.when(F.col("fine"), "superseded").otherwise("damaged").alias("action"), none("content"), none("sha256"))
    return told.unionByName(rest)


def exported(plan: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry (target, source_id, sha256) after a plan is carried out: what it wrote is its sources', the rest stays."""
    wrote = plan.filter("action IN ('create', 'overwrite')").groupBy("target").agg(F.min(F.struct("doc_id", "source_id", "sha256")).alias("w"))
    mine = wrote.select("target", F.col("w.source_id").alias("source_id"), F.col("w.sha256").alias("sha256"))
    return registry.select("target", "source_id", "sha256").join(_shuffled(mine.select(F.lower("target").alias("path"))), F.lower("target") == F.col("path"), "left_anti").unionByName(mine)
