"""Queues of files and their runs: contracts, summaries, limits, caches, safe listings, reports and what is sent for judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import settled

from .ranges import dealt_to, tasks_for

#: Bytes of excerpts that a task gathers.
TASK_BYTES = 64_000_000
#: A package's identity, the control files of a package, what a listing tells of a result.
PACKAGE = "[0-9a-f]{64}(?:-recuperado-[0-9a-f]{8})?"
CONTROL_FILES = ("document.json", "documento.md", "verificacion.json", "manifest.json")
TOLD = ("id", "status", "reused", "provider", "response_reused", "usage", "reported_tokens", "started_call", "consumption_unknown", "error", "signature", "phase", "code")
#: Texts of an entry of a queue, and states that count as ready and as pending.
ENTRY_TEXTS = ("path", "name", "format", "status", "action")
READY, WAITING = ("listo", "requiere_paginas"), ("pendiente", "en_nube")
#: Files a run may take, its default; candidates, and characters, of one judgement.
MOST_FILES, USUAL_FILES = 200, 20
MOST_CANDIDATES, QUERY_CHARS, EXCERPT_CHARS, BLOCK_CHARS = 10, 2000, 5000, 100
#: Bytes of a whole request; what a report says of the limits it tells.
MOST_REQUEST = 60_000
NOTICE = "> Este control limita invocaciones del programa. Un CLI puede realizar llamadas internas. Los tokens reportados se conocen después de la respuesta y pueden superar el umbral en la última página."


def last_name(path: Column) -> Column:
    """The last part of a path, whichever slash it uses."""
    return F.regexp_extract(path, "([^/\\\\]*)[/\\\\]*\\z", 1)


def package_name(path: Column) -> Column:
    """The package that a stored path names, null if its last part is no package identity."""
    return F.when(F.rlike(last_name(path), F.lit(f"^{PACKAGE}\\z")), last_name(path))


def queue_contract(entries: DataFrame) -> DataFrame:
    """queue, entries, invalid, repeated, accepted: queues of entries (queue, the entry's texts, bytes) against their contract.

    An entry needs every text and bytes of 0 or more; a path belongs to one entry, each further one counts as
    repeated. Paths are counted before their queue, so that a queue of any size is combined in parts.
    """
    bad = F.col("bytes").isNull() | (F.col("bytes") < 0)
    for name in ENTRY_TEXTS:
        bad = bad | F.col(name).isNull() | (F.col(name) == "")
    paths = entries.groupBy("queue", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    again = F.when(F.coalesce("path", F.lit("")) != "", F.col("n") - 1).otherwise(0)
    told = paths.groupBy("queue").agg(F.sum("n").alias("entries"), F.sum("bad").alias("invalid"), F.sum(again).alias("repeated"))
    return told.withColumn("accepted", (F.col("invalid") == 0) & (F.col("repeated") == 0))


def queue_summary(entries: DataFrame) -> DataFrame:
    """queue, total, ready, completed (with an output), pending, in one pass."""
    return entries.groupBy("queue").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(*READY)).alias("ready"), F.count_if(F.coalesce("output", F.lit("")) != "").alias("completed"), F.count_if(F.col("status").isin(*WAITING)).alias("pending"),
    )


def told_results(results: DataFrame) -> DataFrame:
    """The columns of results that a listing may tell; outputs by package, run folders by name, nothing else of any path."""
    shown = [F.col(c) for c in TOLD if c in results.columns]
    shown += [f(F.col(c)).alias(c) for c, f in (("output", package_name), ("run_folder", last_name)) if c in results.columns]
    return results.select(*shown)


def refused_assets(packages: DataFrame) -> DataFrame:
    """package and names of packages (package, assets: array) whose assets would replace control files."""
    control = F.array(*map(F.lit, CONTROL_FILES))
    return packages.filter(F.arrays_overlap("assets", control)).select("package", F.array_sort(F.array_intersect("assets", control)).alias("names"))


def cached_engine_results(asked: DataFrame, packages: DataFrame, most_bytes: int = 32_000_000) -> DataFrame:
    """asked (signature) with package: the newest intact package (id, signature, updated, integrity_ok, bytes) of that engine run within size."""
    usable = packages.filter(F.col("integrity_ok") & (F.col("bytes") <= most_bytes) & F.col("signature").isNotNull())
    return asked.join(usable.groupBy("signature").agg(F.max_by("id", F.struct("updated", "id")).alias("package")), "signature", "left")


def run_files(items: DataFrame, limit: int = USUAL_FILES, retry_errors: bool = False) -> DataFrame:
    """Of each batch's items (batch, position, state) the first ones that a run takes, by position.

    Finished and delegated items are not taken; failed ones only when asked for. Spark keeps no more than
    `limit` rows a task and batch before the shuffle.
    """
    if not 1 <= limit <= MOST_FILES:
        raise ValueError(f"a run takes 1 to {MOST_FILES} files")
    open_ = items.filter(F.col("state").isin("listo", *(("error",) if retry_errors else ())))
    nth = F.row_number().over(Window.partitionBy("batch").orderBy("position"))
    return open_.withColumn("nth", nth).filter(F.col("nth") <= limit)


def state_counts(items: DataFrame) -> DataFrame:
    """batch, state, n: items by state in each batch, and over all batches (batch null)."""
    one = items.groupBy("batch", "state").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(one.groupBy("state").agg(F.sum("n").alias("n")).withColumn("batch", F.lit(None).cast(items.schema["batch"].dataType)))


def outcome_counts(records: DataFrame) -> DataFrame:
    """suite, files, met, unmet of records (suite, met); an unknown outcome is unmet."""
    met = F.coalesce("met", F.lit(False))
    return records.groupBy("suite").agg(F.count(F.lit(1)).alias("files"), F.count_if(met).alias("met"), F.count_if(~met).alias("unmet"))


def rule_totals(findings: DataFrame) -> DataFrame:
    """rule, findings, packages: findings (package, rule) by rule, and in all (rule null)."""
    one = findings.groupBy("package", "rule").agg(F.count(F.lit(1)).alias("n"))
    by_rule = one.groupBy("rule").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("packages"))
    packages = one.groupBy("package").agg(F.sum("n").alias("n"))
    return by_rule.unionByName(packages.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.count(F.lit(1)).alias("packages")).withColumn("rule", F.lit(None).cast("string")))


def first_told(faults: DataFrame, most: int) -> DataFrame:
    """doc_id, nth, text, hidden: the first `most` of each document's faults (doc_id, position, text), and how many more there are."""
    order = Window.partitionBy("doc_id").orderBy("position", "text")
    shown = faults.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    counts = faults.groupBy("doc_id").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("hidden"))
    return shown.join(counts, "doc_id").select("doc_id", "nth", "text", "hidden")


def judgement_payloads(hits: DataFrame) -> DataFrame:
    """query_id, candidates, fault, body: what is sent of hits (query_id, query, document_id, unit, block_id, excerpt, excerpt_truncated, rank).

    The body is JSON of the query and its candidates by rank: identities and excerpts, no paths. A request with
    more candidates than allowed, a blank or overlong query or excerpt, a wrong identity or a repeated one is
    refused whole: its fault is told and it has no body. Refused requests never gather their hits. A body of over
    MOST_REQUEST bytes is refused as well, not cut; one whose excerpts alone are more is refused before it is gathered.

    What is told of requests is written once. Excerpts are dealt by request to tasks of TASK_BYTES that are sent, and
    pass by the requests' ids unsorted.
    """
    blank = lambda c: ~F.rlike(F.coalesce(c, F.lit("")), F.lit("\\S"))
    wrong = ~F.coalesce(F.rlike("document_id", F.lit(f"^{PACKAGE}\\z")) & (F.col("unit") >= 1) & (F.length("block_id").between(1, BLOCK_CHARS)), F.lit(False))
    # An identity that is not wrong is told by this text, and moves as its digest.
    identity = F.unhex(F.sha2(F.concat_ws(" ", "document_id", F.col("unit").cast("string"), "block_id"), 256)).alias("identity")
    one = hits.groupBy("query_id", identity).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(blank("query") | (F.length("query") > QUERY_CHARS)).alias("query_bad"), F.bool_or(wrong).alias("wrong"), F.bool_or(blank("excerpt") | (F.length("excerpt") > EXCERPT_CHARS)).alias("excerpt_bad"),
        F.sum(F.octet_length("excerpt").cast("long")).alias("bytes"),
    )
    checked = one.groupBy("query_id").agg(F.sum("n").alias("candidates"), F.max("n").alias("most"), F.sum("bytes").alias("bytes"), *[F.bool_or(c).alias(c) for c in ("query_bad", "wrong", "excerpt_bad")])
    fault = F.when(F.col("query_bad"), "query").when(F.col("candidates") > MOST_CANDIDATES, "candidates").when(F.col("wrong"), "identity").when(F.col("most") > 1, "repeated").when(F.col("excerpt_bad"), "excerpt")
    fault = F.coalesce(fault, F.when(F.col("bytes") > MOST_REQUEST, "size"))
    checked = settled(checked.select("query_id", "candidates", fault.alias("fault"), "bytes"), "requests")
    asked, other = checked.filter("fault IS NULL AND query_id IS NOT NULL"), checked.filter("fault IS NOT NULL OR query_id IS NULL")
    size = asked.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("rows")).first()
    tasks = max(tasks_for(size["rows"]), tasks_for(size["bytes"], TASK_BYTES))
    # An inner join by unique ids: Spark would push a semi join below the dealing, and move the excerpts twice.
    sent = dealt_to(hits, tasks, "query_id").join(asked.select("query_id").hint("shuffle_hash"), "query_id")
    candidate = F.struct("rank", F.struct("document_id", "unit", "block_id", F.col("excerpt").alias("text"), F.coalesce("excerpt_truncated", F.lit(False)).alias("truncated")).alias("c"))
    bodies = sent.groupBy("query_id").agg(F.min("query").alias("query"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(candidate)), lambda x: x["c"]).alias("candidates"))
    told = bodies.select("query_id", F.col("n").alias("candidates"), F.to_json(F.struct("query", "candidates")).alias("body"))
    large = F.octet_length("body") > MOST_REQUEST
    told = told.select("query_id", "candidates", F.when(large, "size").alias("fault"), F.when(~large, F.col("body")).alias("body"))
    return told.unionByName(other.select("query_id", "candidates", "fault", F.lit(None).cast("string").alias("body")))


def batch_reports(batches: DataFrame, items: DataFrame) -> DataFrame:
    """batch, markdown: a batch's title, state, policy and budget, then a line for each page with its output, tokens or error.

    Batches (batch, title, state, provider, model, key_slot, cli_profile, calls, call_budget, tokens, token_budget,
    unknown: calls of unknown consumption, output), items (batch, position, unit,
    state, output, tokens, signature, error). A plan holds at most 200 pages, so a batch's lines fit one row.
    """
    link = lambda c: F.concat(F.lit("[MD](<../documentos/"), package_name(c), F.lit("/documento.md>)"))
    line = F.concat_ws(
        " · ", F.concat(F.lit("- Página "), "unit", F.lit(": **"), "state", F.lit("**")), link(F.col("output")), F.concat("tokens", F.lit(" tokens")),
        F.concat(F.lit("error `"), F.coalesce("signature", F.lit("sin-firma")), F.lit("`: "), "error"),
    )
    lines = items.select("batch", F.struct("position", line.alias("line")).alias("l")).groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("lines"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    head = F.concat(
        F.lit("# Lote IA — "), text("title"), F.lit("\n\nID: `"), text("batch"), F.lit("` · estado: **"), text("state"), F.lit("**\n\nProveedor/modelo: `"), text("provider"), F.lit("` / `"), text("model"), F.lit("` · perfil API: "), text("key_slot"),
        F.lit(" · perfil CLI: `"), text("cli_profile"), F.lit("`\n\nPresupuesto: "), text("call_budget"), F.lit(" invocaciones · "), text("token_budget"), F.lit(" tokens reportados. Acumulado: "), text("calls"), F.lit(" · "), text("tokens"),
        F.lit("; desconocidas: "), text("unknown"), F.lit(f".\n\n{NOTICE}\n\n"),
    )
    united = F.concat(F.lit("\n\n## Resultado unido\n\n"), link(F.col("output")))
    return batches.join(lines, "batch", "left").select("batch", F.concat(head, F.coalesce("lines", F.lit("")), F.coalesce(united, F.lit("")), F.lit("\n")).alias("markdown"))
