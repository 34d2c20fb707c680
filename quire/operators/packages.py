"""Packages and batches: page imports, prepared caches, merges, ledgers, deletions, histories, reports and checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import settled

from .ranges import tasks_for

#: A plan holds this many pages at most, a history this many runs.
MOST_PAGES, MOST_RUNS = 200, 200
BLANK = "^[\\s\\ufeff]*$"


def import_pages(expected: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """doc_id, unit, state, text: expected units (doc_id, expected: array) met with files (doc_id, name, text).

    A file `prefix_p0*N.md` is unit N, whatever its leading zeros. state: missing, ambiguous (two files of one
    unit), empty or imported; only imported units carry a text, without its byte order mark.
    """
    number = F.nullif(F.regexp_extract("name", f"^{re.escape(prefix)}_p0*([1-9][0-9]*)\\.md$", 1), F.lit("")).try_cast("int")
    held = files.select("doc_id", number.alias("unit"), F.regexp_replace("text", "^\\ufeff", "").alias("text")).filter("unit IS NOT NULL")
    held = held.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("files"), F.min("text").alias("text"))
    rows = expected.select("doc_id", F.explode(F.array_distinct("expected")).alias("unit")).join(held, ["doc_id", "unit"], "left")
    blank = F.coalesce(F.rlike("text", F.lit(BLANK)), F.lit(True))
    state = F.when(F.col("files").isNull(), "missing").when(F.col("files") > 1, "ambiguous").when(blank, "empty").otherwise("imported")
    return rows.select("doc_id", "unit", state.alias("state"), F.when(state == "imported", F.col("text")).alias("text"))


def prepared(requests: DataFrame, packages: DataFrame, version: int) -> DataFrame:
    """requests (sha256, pages, dpi) with prepared_id: the newest intact package of equal bytes, pages in order, dpi and version."""
    usable = packages.filter((F.col("version") == version) & F.col("integrity_ok"))
    newest = usable.groupBy("sha256", "pages", "dpi").agg(F.max_by("id", F.struct("updated", "id")).alias("prepared_id"))
    return requests.join(newest, ["sha256", "pages", "dpi"], "left")


def unfinished_sources(batches: DataFrame, wanted: DataFrame) -> DataFrame:
    """source and batch: of wanted (source) those that an unfinished batch (batch, source, state) still reads; its largest batch."""
    return batches.filter("state <> 'finalizado'").join(wanted.select("source"), "source", "left_semi").groupBy("source").agg(F.max("batch").alias("batch"))


def orphan_batches(batches: DataFrame, intact: DataFrame) -> DataFrame:
    """batch: those of batches (batch, source, output) whose source or result is not an intact package; nulls point nowhere."""
    ends = batches.select("batch", F.explode(F.array_compact(F.array("source", "output"))).alias("package"))
    return ends.join(intact.select("package"), "package", "left_anti").select("batch").distinct()


def item_states(plans: DataFrame, states: DataFrame) -> DataFrame:
    """batch, position, path, state: the items of plans (batch, paths) with their state, `listo` where none is told."""
    items = plans.select("batch", F.posexplode("paths").alias("position", "path"))
    return items.join(states, ["batch", "position"], "left").withColumn("state", F.coalesce("state", F.lit("listo")))


def merge_batch(items: DataFrame, units: DataFrame) -> DataFrame:
    """Batches of items (batch, position, unit, package) merged from their packages' units (package, unit, text).

    Each item needs exactly one unit of its number in its package. batch, items, merged, problems (`unit: absent`
    or `unit: several`, in order), status and markdown (null if refused). A batch holds at most 200 pages.
    """
    items = settled(items, "items")
    tasks = tasks_for(items.count())
    tasks = max(tasks, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if tasks > 1 else tasks
    in_tasks = lambda df, *key: df.repartition(tasks, *key) if tasks > 1 else df  # noqa: E731  more than one task's rows are not merged again by their compressed bytes
    own = in_tasks(units, "package", "unit").groupBy("package", "unit").agg(F.count(F.lit(1)).alias("found"), F.min("text").alias("text"))
    rows = in_tasks(in_tasks(items, "package", "unit").join(own, ["package", "unit"], "left"), "batch")
    fault = F.when(F.col("found").isNull(), "absent").when(F.col("found") > 1, "several")
    ordered = F.array_sort(F.collect_list(F.struct("position", "unit", fault.alias("fault"), F.coalesce("text", F.lit("")).alias("text"))))
    out = rows.groupBy("batch").agg(ordered.alias("all"))
    wrong = F.transform(F.filter("all", lambda x: x["fault"].isNotNull()), lambda x: F.concat(x["unit"], F.lit(": "), x["fault"]))
    out = out.withColumn("wrong", wrong)
    fine = F.size("wrong") == 0
    return out.select(
        "batch", F.size("all").alias("items"), (F.size("all") - F.size("wrong")).alias("merged"), F.array_join("wrong", ", ").alias("problems"),
        F.when(fine, "published").otherwise("refused").alias("status"), F.when(fine, F.array_join(F.transform("all", lambda x: x["text"]), "")).alias("markdown"),
    )


def page_warnings(items: DataFrame, warnings: DataFrame) -> DataFrame:
    """batch, position, warning: the warnings (package, warning) of each item's package, told by its page."""
    return items.join(warnings, "package").select("batch", "position", F.concat(F.lit("Página "), F.col("unit"), F.lit(": "), F.col("warning")).alias("warning"))


def plan_ids(items: DataFrame, policy: str) -> DataFrame:
    """batch, pages, plan_id: the same id for the same pages (batch, position, unit, sha256) under the same policy.

    Null for a plan of over 200 pages.
    """
    counts = items.groupBy("batch").agg(F.count(F.lit(1)).alias("pages"))
    # Only plans of bounded length are gathered, whatever the size of the others.
    short = items.join(counts.filter(F.col("pages") <= MOST_PAGES).select("batch"), "batch", "left_semi")
    line = F.concat_ws("|", "position", "unit", F.coalesce("sha256", F.lit("-")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])
    ids = short.groupBy("batch").agg(F.sha2(F.concat(F.lit(policy + "\n"), F.array_join(lines, "\n")), 256).alias("plan_id"))
    return counts.join(ids, "batch", "left").select("batch", "pages", "plan_id")


def reserve(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """job, signature, action: what may be sent of jobs (job, signature), given a ledger (signature, response).

    `reuse` where a response is saved; `review` where a signature was reserved but nothing came back, which is
    never sent again; `send` for the first job of a new signature, `wait` for its repeats.
    """
    told = ledger.groupBy("signature").agg(F.count("response").alias("responses"))
    first = jobs.groupBy("signature").agg(F.min("job").alias("first"))
    known = first.join(told, "signature", "left")
    action = F.when(F.col("responses") > 0, "reuse").when(F.col("responses") == 0, "review").when(F.col("job") == F.col("first"), "send").otherwise("wait")
    return jobs.join(known, "signature").select("job", "signature", action.alias("action"))


def over_cap(assets: DataFrame, most: int) -> DataFrame:
    """doc_id, bytes, accepted: the bytes of each package's assets (doc_id, bytes); a package over the cap goes whole."""
    return assets.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")).withColumn("accepted", F.col("bytes") <= most)


def deletions(requested: DataFrame, catalog: DataFrame, remaining: DataFrame) -> DataFrame:
    """doc_id, outcome: `unknown` if not in the catalog, `failed` while its folder remains, else `deleted`; one row a doc_id."""
    rows = requested.select("doc_id").distinct()
    for side, mark in ((catalog, "known"), (remaining, "left")):
        rows = rows.join(side.select("doc_id").distinct().withColumn(mark, F.lit(True)), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("known").isNull(), "unknown").when(F.col("left"), "failed").otherwise("deleted").alias("outcome"))


def manifest_problems(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """file, status: files of a manifest (file, sha256) that the disk (file, sha256) lacks (ausente) or holds changed (modificado)."""
    rows = manifest.join(disk.select("file", F.col("sha256").alias("held"), F.lit(True).alias("there")), "file", "left")
    status = F.when(F.col("there").isNull(), "ausente").when(~F.col("sha256").eqNullSafe(F.col("held")), "modificado")
    return rows.select("file", status.alias("status")).filter("status IS NOT NULL")


def run_history(runs: DataFrame, receipts: DataFrame, errors: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs (run, started) with tokens (run, tokens) and errors (run): the limit comes before the joins."""
    if not 1 <= limit <= MOST_RUNS:
        raise ValueError("a history holds 1 to 200 runs")
    newest = F.broadcast(runs.orderBy(F.desc("started"), F.desc("run")).limit(limit))  # at most MOST_RUNS rows
    told = receipts.join(newest.select("run"), "run", "left_semi").groupBy("run").agg(F.sum("tokens").alias("tokens"))
    wrong = errors.join(newest.select("run"), "run", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("errors"))
    return newest.join(told, "run", "left").join(wrong, "run", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


def library_index(catalog: DataFrame) -> DataFrame:
    """title, doc_id, line: an index in the order of titles, of rows with status, integrity_ok, received, expected and warnings."""
    title = F.translate(F.regexp_replace("title", "\n", " "), "[]", "()")
    covered = F.concat(F.col("received"), F.lit("/"), F.col("expected"), F.lit(" unidades; "), F.col("warnings"), F.lit(" avisos"))
    coverage = F.when(F.col("integrity_ok"), covered).otherwise("integridad dañada")
    line = F.concat(F.lit("- ["), title, F.lit("](<documentos/"), F.col("doc_id"), F.lit("/documento.md>) — **"), F.col("status"), F.lit("**, "), coverage, F.lit("."))
    return catalog.select("title", "doc_id", line.alias("line")).orderBy("title", "doc_id")


def write_lines(lines: DataFrame, folder: str) -> None:
    """An ordered report as text files of the folder; their names keep the order."""
    lines.select("line").write.mode("overwrite").text(folder)


def failure_report(failures: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Failures (signature, last_seen, ...) with the resolutions (signature, resolved_at, cause) nested in the order of time."""
    nested = resolutions.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("resolved_at", "cause"))).alias("history"))
    out = failures.join(nested, "signature", "left")
    return out.withColumn("history", F.coalesce("history", F.array().cast(out.schema["history"].dataType))).orderBy(F.desc("last_seen"), "signature")


def batch_report(plan: DataFrame, states: DataFrame) -> DataFrame:
    """number, line: a line a file of a plan (number, format, route, duplicate_of, reason) with its state (number, state)."""
    why = F.coalesce(F.col("reason"), F.concat(F.lit("igual a "), F.col("duplicate_of")), F.lit("-"))
    line = F.concat_ws(" | ", F.col("number"), F.col("format"), F.col("route"), F.coalesce("state", F.lit("sin estado")), why)
    return plan.join(states, "number", "left").select("number", line.alias("line"))


def check(name: str, rows: DataFrame, fault: Column) -> DataFrame:
    """One row of a diagnosis: check, total, faults, status (OK or ATENCION)."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(fault).alias("faults")).select(F.lit(name).alias("check"), "total", "faults", F.when(F.col("faults") > 0, "ATENCION").otherwise("OK").alias("status"))


def summed_usage(*counters: Column) -> Column:
    """The sum of disjoint counters, null if one of them is absent or negative: an absence is never a zero."""
    total = F.when(counters[0] >= 0, counters[0])
    for c in counters[1:]:
        total = total + F.when(c >= 0, c)
    return total


def list_levels(items: DataFrame) -> DataFrame:
    """Items (doc_id, ord, is_list, level) with `nested`: a list item is at most one deeper than the item before it.

    Runs of list items start anew after others. The bound is a running minimum: an item's depth is the least of
    its own and of every earlier item's plus their distance, and the first of a run has depth 0.
    """
    run = F.sum((~F.col("is_list")).cast("int")).over(Window.partitionBy("doc_id").orderBy("ord"))
    listed = items.withColumn("run", run)
    by = Window.partitionBy("doc_id", "run", "is_list").orderBy("ord")
    listed = listed.withColumn("nth", F.row_number().over(by) - 1)
    least = F.min(F.col("level") - F.col("nth")).over(by)
    return listed.select("doc_id", "ord", "is_list", "level", F.when(F.col("is_list"), F.least(F.col("nth"), least + F.col("nth"))).alias("nested"))
