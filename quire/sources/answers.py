"""Structured answers: JSON that keeps to its contract, and package identities."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import canonical, fenced_json
from quire.operators.documents import KINDS

ANSWER = "job string, unit int, blocks array<struct<kind:string,text:string>>"
BLANK = " \t\n\x0b\x0c\r"
#: The keys an answer has, and the most characters it may have.
KEYS, LONGEST = ("blocks", "job", "unit"), 2_000_000


def _unquoted(body: Column) -> Column:
    """What stands outside of the strings of a JSON text: escapes go first, then every second piece between quotes. Linear, without a pattern."""
    pieces = F.split(F.replace(F.replace(body, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), '"')
    return F.array_join(F.filter(pieces, lambda _, i: i % 2 == 0), '""')


def read_answers(answers: DataFrame) -> DataFrame:
    """doc_id, accepted, reason and blocks of answers (doc_id, job, unit, answer).

    Strict: no repeated keys, no NaN, exactly the keys of the contract, the job and unit that were asked, and at
    least one block, each of a known kind and with text. Texts are trimmed at the right and end in a blank line.
    """
    body = fenced_json(F.col("answer"))
    told = answers.withColumn("body", body).withColumn("strict", F.expr("try_parse_json(body)").isNotNull() & ~F.rlike(_unquoted(F.col("body")), F.lit("\\b(NaN|Infinity)\\b")))
    told = told.withColumn("a", F.from_json(F.when(F.col("strict"), F.col("body")), ANSWER))
    keys = F.array_sort(F.json_object_keys(F.when(F.col("strict"), F.col("body"))))
    bad_block = F.exists("a.blocks", lambda b: ~F.coalesce(b["kind"].isin(*KINDS), F.lit(False)) | (F.coalesce(F.btrim(b["text"], F.lit(BLANK)), F.lit("")) == ""))
    reason = (
        F.when(F.length("answer") > LONGEST, "too long").when(~F.coalesce("strict", F.lit(False)), "not strict JSON").when(~F.coalesce(keys == F.array(*map(F.lit, KEYS)), F.lit(False)), "keys")
        .when(~F.col("a.job").eqNullSafe(F.col("job")) | ~F.col("a.unit").eqNullSafe(F.col("unit")), "another job").when(F.coalesce(F.size("a.blocks"), F.lit(0)) < 1, "no blocks").when(bad_block, "block")
    )
    texts = F.transform("a.blocks", lambda b: F.struct(b["kind"].alias("kind"), F.concat(F.rtrim(b["text"], F.lit(BLANK)), F.lit("\n\n")).alias("text")))
    return told.withColumn("reason", reason).select("doc_id", F.col("reason").isNull().alias("accepted"), "reason", F.when(F.col("reason").isNull(), texts).alias("blocks"))


def package_ids(documents: DataFrame, version: int, identity: list[str]) -> DataFrame:
    """documents with package_id: a hash of the converter's version and the identity columns, so of neither path nor place."""
    fields = {c: F.col(c) for c in identity} | {"version": F.lit(version)}
    return documents.withColumn("package_id", F.sha2(canonical(fields), 256))


def publish(documents: DataFrame, catalog: DataFrame | None, folder: str) -> DataFrame:
    """Append the packages that catalog (package_id, integrity_ok) does not hold intact; what was new.

    A package is written once: repeated rows are one, and a second run with the new catalog adds nothing. Each run
    writes a part of its own below folder, which Spark's committer makes whole or leaves without _SUCCESS; the
    result is read from there, so it is what was written, and catalog may be read from the same folder.
    """
    new = documents.dropDuplicates(["package_id"])
    if catalog is not None:
        new = new.join(catalog.filter("integrity_ok").select("package_id"), "package_id", "left_anti")
    path = f"{folder}/run={uuid.uuid4().hex}"
    new.write.parquet(path)
    return documents.sparkSession.read.schema(new.schema).parquet(path)
