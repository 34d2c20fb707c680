"""The library: batch routes, budgets, catalog, integrity, caches, repair, failures, queue and export names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import failure_signature, safe_filename

from .ranges import HOT, numbered

#: Kinds that can be converted locally, reasons for those that cannot, and required files of a package.
LOCAL_TEXT = ("txt", "md", "text")
NATIVE = ("docx", "xlsx", "pptx", "vsdx", "xls", "doc", "ppt", "xlsb", "png", "jpg", "tif", "gif", "webp")
LOCAL = LOCAL_TEXT + NATIVE
REASONS = {"pdf": "choose pages first", "office-legacy": "no adapter", "dwg": "review geometry one by one", "dxf": "review geometry one by one", "deferred": "download first", "zip-damaged": "damaged archive"}
#: Why content of a sniffed kind is refused, and the most pages of a PDF that are prepared at once.
REFUSED = {
    "empty": "empty file", "zip-damaged": "damaged archive", "zip": "archive of no document", "zip-ambiguous": "archive of several kinds",
    "office-legacy": "binary document of another program", "unsupported": "unknown binary content",
}
MOST_PAGES = 2000
REQUIRED = ("document.json", "documento.md", "verificacion.json")
ATTENTION = ("error", "consumo_desconocido", "requiere_revision", "bloqueado")


def action_for(kind: Column) -> Column:
    """The state in which a file of this kind enters the queue."""
    return F.when(kind.isin(*LOCAL), "listo").when(kind == "pdf", "requiere_paginas").when(kind == "deferred", "en_nube").otherwise("pendiente")


def plan_routes(queue: DataFrame) -> DataFrame:
    """number, format, sha256 with route, duplicate_of and reason.

    Only files that can be converted here count as first of their content. Firsts are combined by content
    before they meet the files again, so that a content with very many copies is one row there.
    """
    usable = F.coalesce(F.col("format").isin(*LOCAL) & F.col("sha256").isNotNull(), F.lit(False))
    firsts = queue.filter(usable).groupBy("sha256").agg(F.min("number").alias("first"))
    joined = queue.join(firsts, "sha256", "left")
    route = F.when(~usable, "pendiente").when(F.col("first") < F.col("number"), "duplicado").otherwise("local")
    reason = F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("format")], F.lit("outside the local batch"))
    return joined.select("number", "format", "sha256", route.alias("route"), F.when(route == "duplicado", F.col("first")).alias("duplicate_of"), F.when(route == "pendiente", reason).alias("reason"))


def entry_routes(found: DataFrame) -> DataFrame:
    """path, kind, pages with route (text, native, pages, refused) and reason of sniffed files (path, kind, pages).

    pages: how many a PDF has, null if it cannot be read; it says nothing of other kinds. Every refused file has a reason.
    """
    kind, pages = F.col("kind"), F.col("pages")
    of_pdf = F.when(pages.isNull(), "damaged document").when(pages < 1, "no pages").when(pages > MOST_PAGES, "prepare its pages in parts")
    why = F.try_element_at(F.create_map(*[F.lit(x) for pair in REFUSED.items() for x in pair]), kind)
    other = F.coalesce(why, F.concat(F.lit("no adapter for "), kind), F.lit("unknown kind"))
    reason = F.when(kind == "pdf", of_pdf).when(~F.coalesce(kind.isin(*LOCAL), F.lit(False)), other)
    route = F.when(reason.isNotNull(), "refused").when(kind == "pdf", "pages").when(kind.isin(*LOCAL_TEXT), "text").otherwise("native")
    return found.select("path", "kind", "pages", route.alias("route"), reason.alias("reason"))


def route_counts(plan: DataFrame) -> DataFrame:
    """Counts by route and by format in one pass: dimension, value, n."""
    return (
        plan.groupingSets([["route"], ["format"]], "route", "format")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("route").alias("g"))
        .select(F.when(F.col("g") == 0, "route").otherwise("format").alias("dimension"), F.when(F.col("g") == 0, F.col("route")).otherwise(F.col("format")).alias("value"), "n")
    )


def origins(files: DataFrame) -> DataFrame:
    """sha256 with its number of files, first file and distinct sources."""
    return files.groupBy("sha256").agg(F.count(F.lit(1)).alias("files"), F.min("number").alias("first"), F.array_sort(F.collect_set("source")).alias("sources"))


def integrity(artifacts: DataFrame) -> DataFrame:
    """doc_id, integrity_ok, damaged: all required files are there and every file's hash is the recorded one."""
    damaged = F.array_sort(F.collect_set(F.when(~F.col("sha256").eqNullSafe(F.col("actual_sha256")), F.col("name"))))
    held = F.collect_set(F.when(F.col("actual_sha256").isNotNull(), F.col("name")))
    found = artifacts.groupBy("doc_id").agg(damaged.alias("damaged"), held.alias("held"))
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), "held"))
    return found.select("doc_id", ((F.size("damaged") == 0) & (F.size(lacking) == 0)).alias("integrity_ok"), F.array_sort(F.array_union("damaged", lacking)).alias("damaged"))


def cached(requests: DataFrame, cache: DataFrame, intact: DataFrame, version: int) -> DataFrame:
    """requests (sha256) with the newest intact package of this version that was made of the same bytes."""
    usable = cache.filter(F.col("version") == version).join(intact.filter("integrity_ok").select(F.col("doc_id").alias("id")), "id", "left_semi")
    newest = usable.groupBy("sha256").agg(F.max_by("id", F.struct("updated", "id")).alias("cached_id"))
    return requests.join(newest, "sha256", "left")


def repair_plan(catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """action and doc_id: catalog rows without folder are pruned, intact folders without row adopted, damaged ones reported."""
    pruned = catalog.join(folders, "doc_id", "left_anti").select(F.lit("prune").alias("action"), "doc_id")
    adopted = folders.filter("integrity_ok").join(catalog, "doc_id", "left_anti").select(F.lit("adopt").alias("action"), "doc_id")
    damaged = folders.filter("NOT integrity_ok").join(catalog, "doc_id", "left_semi").select(F.lit("damaged").alias("action"), "doc_id")
    return pruned.unionByName(adopted).unionByName(damaged)


def group_failures(events: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """One row a signature of events (ts, operation, error_type, message): counts, times, latest message, status.

    With resolutions (signature, resolved_at) a failure is open again once it recurs after the last of them.
    """
    signed = events.withColumn("signature", failure_signature(F.col("operation"), F.col("error_type"), F.col("message")))
    found = signed.groupBy("signature").agg(
        F.first("operation").alias("operation"), F.first("error_type").alias("error_type"), F.count(F.lit(1)).alias("occurrences"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("message", F.struct("ts", "message")).alias("message"),
    )
    if resolutions is None:
        return found.withColumn("status", F.lit("abierto"))
    solved = resolutions.groupBy("signature").agg(F.max("resolved_at").alias("resolved_at"), F.count(F.lit(1)).alias("resolutions"))
    status = F.when(F.col("resolved_at") >= F.col("last_seen"), "resuelto").otherwise("abierto")
    return found.join(solved, "signature", "left").withColumns({"status": status, "resolutions": F.coalesce("resolutions", F.lit(0))})


def resolve_failures(failures: DataFrame, asked: DataFrame) -> DataFrame:
    """signature, cause, evidence and status (`resuelto` or `rechazado`) with reason, for each asked resolution (signature, cause, evidence).

    A resolution needs a cause and an evidence that are not blank, and a signature that failures has. Nulls are blank.
    """
    blank = lambda c: F.col(c).isNull() | F.rlike(c, F.lit("(?U)^\\s*$"))
    known = failures.select("signature", F.lit(True).alias("known")).distinct()
    reason = F.when(blank("cause") | blank("evidence"), "cause and evidence are needed").when(F.col("known").isNull(), "unknown signature")
    told = asked.join(known, "signature", "left").withColumn("reason", reason)
    return told.select("signature", "cause", "evidence", F.when(F.col("reason").isNull(), "resuelto").otherwise("rechazado").alias("status"), "reason")


def classify_error(kind: Column) -> Column:
    """The probable cause of an error type, in order of precedence."""
    return (
        F.when(kind == "FileNotFoundError", "path").when(kind == "PermissionError", "access").when(kind.isin("UnicodeDecodeError", "UnicodeError"), "encoding")
        .when(kind.isin("ImportError", "ModuleNotFoundError"), "dependency").when(kind.isin("OperationalError", "DatabaseError"), "index").when(kind == "ValueError", "control").otherwise("unknown")
    )


#: What to do next about a cause.
REMEDIES = {
    "path": "choose the source again", "access": "close the file and check the folder's rights", "encoding": "keep the original and state its encoding",
    "dependency": "run the diagnosis before anything is installed", "index": "close other processes and repair", "control": "correct the value that was told",
    "unknown": "repeat once with the same source and keep the record",
}


def remedy_for(cause: Column) -> Column:
    """The next step for a cause of `classify_error`; null for any other word."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in REMEDIES.items() for x in pair]), cause)


def run_budget(items: DataFrame, call_budget: int, token_budget: int) -> DataFrame:
    """Items (batch, position, calls: 0 or 1, tokens, null if unknown) with whether a run starts them.

    An item starts while the calls and tokens before it are under both budgets, so that the last one may go
    over; an unknown consumption stops the batch behind it. The windows run within one batch, whose items a
    plan keeps to a few hundred.
    """
    before = Window.partitionBy("batch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    unknown = F.coalesce(F.max(((F.col("calls") == 1) & F.col("tokens").isNull()).cast("int")).over(before), F.lit(0))
    calls = F.coalesce(F.sum("calls").over(before), F.lit(0))
    used = F.coalesce(F.sum(F.when(F.col("calls") == 1, F.coalesce("tokens", F.lit(0))).otherwise(0)).over(before), F.lit(0))
    return items.withColumns({"calls_before": calls, "tokens_before": used, "unknown_before": unknown}).withColumn("starts", (F.col("calls_before") < call_budget) & (F.col("tokens_before") < token_budget) & (F.col("unknown_before") == 0))


def budget_summary(started: DataFrame) -> DataFrame:
    """Per batch: items started, calls, known tokens, unknown consumptions."""
    known = F.col("starts") & (F.col("calls") == 1)
    return started.groupBy("batch").agg(
        F.count_if("starts").alias("started"), F.count_if(known).alias("calls"), F.coalesce(F.sum(F.when(known, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count_if(known & F.col("tokens").isNull()).alias("unknown"),
    )


def reported_tokens(*counters: Column) -> Column:
    """The first counter that is not null and not negative."""
    return F.coalesce(*[F.when(c >= 0, c) for c in counters])


def batch_status(items: DataFrame) -> DataFrame:
    """The status of each batch from its items' states, by precedence, and the number that needs attention."""
    has = lambda *s: F.count_if(F.col("state").isin(*s)) > 0
    done = F.count_if(~F.col("state").isin("terminado", "reutilizado")) == 0
    status = F.when(done, "finalizado").when(has("requiere_revision", "consumo_desconocido"), "requiere_revision").when(has("bloqueado"), "bloqueado").otherwise("pausado")
    return items.groupBy("batch").agg(status.alias("status"), F.count_if(F.col("state").isin(*ATTENTION)).alias("attention"), F.count(F.lit(1)).alias("items"))


def upsert_queue(queue: DataFrame, seen: DataFrame, intact: DataFrame | None = None) -> DataFrame:
    """The queue (path, sha256, status) after an inventory (path, sha256, format): unchanged finished files stay, others are set anew.

    With intact (output: the packages that passed their check) and a queue that tells each file's output, an
    unchanged file stays only if its output is among them; a file set anew loses its output.
    """
    held = queue.select("path", F.col("sha256").alias("old"), "status", *(["output"] if intact is not None else []))
    if intact is not None:
        held = held.join(intact.select("output", F.lit(True).alias("whole")).distinct(), "output", "left")
    both = held.join(seen, "path", "full_outer")
    same = F.col("old").eqNullSafe(F.col("sha256")) & F.col("old").isNotNull()
    kept = same if intact is None else same & F.col("whole").isNotNull()
    status = F.when(F.col("format").isNull() | kept, F.coalesce("status", action_for(F.col("format")))).otherwise(action_for(F.col("format")))
    changed = F.col("old").isNotNull() & F.col("sha256").isNotNull() & ~same
    output = [F.when(F.col("format").isNull() | kept, F.col("output")).alias("output")] if intact is not None else []
    return both.select("path", F.coalesce("sha256", "old").alias("sha256"), status.alias("status"), changed.alias("source_changed"), *output)


def export_names(titles: DataFrame, most: int = HOT) -> DataFrame:
    """doc_id and a file name of its own: equal names, whatever their case, get (2), (3) by doc_id.

    A name that another title has already with its number would clash: such numbers are looked up and the
    clashing names take their doc_id instead. A title of more than most documents is numbered by ranges.
    """
    named = titles.select("doc_id", safe_filename(F.col("title")).alias("base"))
    named = named.withColumn("key", F.lower("base"))
    ranked = numbered(named, "key", ["doc_id"], "nth", most).select("doc_id", "base", "nth")
    ranked = ranked.withColumn("name", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), "nth", F.lit(")"))))
    taken = named.select("key").distinct().withColumn("taken", F.lit(True))
    clash = (F.col("nth") > 1) & F.coalesce("taken", F.lit(False))
    out = ranked.join(taken, F.lower("name") == F.col("key"), "left")
    return out.select("doc_id", F.when(clash, F.concat("base", F.lit(" #"), "doc_id")).otherwise(F.col("name")).alias("name"))


def filter_library(catalog: DataFrame, words: str = "", state: str = "all", structured: bool = False) -> DataFrame:
    """Catalog rows (doc_id, title, status, integrity_ok, input_kind) of a title and state, by title and doc_id."""
    rows = catalog.filter(F.contains(F.lower("title"), F.lit(words.lower())))
    if state == "damaged":
        rows = rows.filter("NOT integrity_ok")
    elif state == "review":
        rows = rows.filter("integrity_ok AND status = 'revisar'")
    return rows if structured else rows.filter("input_kind <> 'structured_response'")
