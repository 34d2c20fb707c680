"""Markdown to blocks, structural checks, and rendering: documents are units, units are blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a block may be.
KINDS = ("heading", "code", "quote", "table", "list", "paragraph", "figure_description")
#: Line ends that start a new line of a block.
LINE_END = "(?<=\\n)|(?<=\\r)(?!\\n)|(?<=[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])"
HEADING, FENCE = "^(#{1,6})[ \\t]+", "^ {0,3}(`{3,}|~{3,})"
DOUBT, IMAGE, ACTIVE = "(?i)\\[(?:ilegible|verificar|pendiente)", "!\\[[^\\]]*\\]\\([^)]+\\)", "(?i)<script\\b|javascript:"
WITNESS = "(?m)^## Testigo\\s*\\(pág\\.\\s*(\\d+)\\)"
STATE = "struct<fence:string,cur:string,out:array<string>>"


def _pieces(text: Column) -> Column:
    """The raw texts of a unit's blocks: one fold over its lines, with the open fence as state; nothing is lost."""
    lines = F.filter(F.split(text, LINE_END), lambda x: x != "")
    start = F.struct(F.lit("").alias("fence"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        marker = F.regexp_extract(x, FENCE, 1)
        state = lambda fence, cur, out: F.struct(fence.alias("fence"), cur.alias("cur"), out.alias("out"))
        shut = F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"]))
        longer = F.concat(s["cur"], x)
        closes = (F.substring(marker, 1, 1) == F.substring(s["fence"], 1, 1)) & (F.length(marker) >= F.length(s["fence"]))
        none = F.lit("")
        return (
            F.when(s["fence"] != "", state(F.when(closes, none).otherwise(s["fence"]), longer, s["out"]))
            .when(marker != "", state(marker, x, shut))
            .when(F.rlike(x, F.lit(HEADING)), state(none, none, F.array_append(shut, x)))
            .when(F.trim(F.regexp_replace(x, "(?U)\\s+", "")) == "", state(none, none, F.array_append(s["out"], longer)))
            .otherwise(state(none, longer, s["out"]))
        )

    return F.aggregate(lines, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"])))


def block_kind(raw: Column) -> Column:
    """heading, code, quote, table, list or paragraph, in this precedence."""
    is_ = lambda pattern: F.rlike(raw, F.lit(pattern))
    return (
        F.when(is_(HEADING), "heading")
        .when(is_("(?U)^\\s*(`{3,}|~{3,})"), "code")
        .when(is_("(?U)^\\s*>"), "quote")
        .when(is_("(?U)^\\s*\\|"), "table")
        .when(is_("(?U)^\\s*(?:[-*+] |\\d+[.)] )"), "list")
        .otherwise("paragraph")
    )


def parse_blocks(units: DataFrame, doc: str = "doc_id", unit: str = "unit", text: str = "text") -> DataFrame:
    """doc_id, unit, block_no, block_id, kind, level, text: the blocks of each unit, each row on its own."""
    cut = units.select(F.col(doc).alias("doc_id"), F.col(unit).alias("unit"), F.posexplode(_pieces(F.col(text))).alias("pos", "raw"))
    level = F.length(F.regexp_extract("raw", HEADING, 1))
    return cut.select(
        "doc_id", "unit", (F.col("pos") + 1).alias("block_no"), F.concat(F.lit("p"), F.col("unit"), F.lit("-b"), F.col("pos") + 1).alias("block_id"),
        block_kind(F.col("raw")).alias("kind"), F.when(level > 0, level).alias("level"), F.col("raw").alias("text"),
    )


def unit_flags(units: DataFrame, paged: bool = False) -> DataFrame:
    """The warnings and the emptiness of each unit (doc_id, unit, text)."""
    has = lambda pattern: F.rlike("text", F.lit(pattern))
    out = units.select(
        "doc_id", "unit", (F.trim(F.regexp_replace("text", "\\s+", "")) == "").alias("is_empty"),
        has(DOUBT).alias("doubt"), has(IMAGE).alias("linked_image"), has(ACTIVE).alias("active_content"),
        (~F.coalesce(F.regexp_extract("text", WITNESS, 1).try_cast("int") == F.col("unit"), F.lit(False))).alias("witness_off"),
    )
    return out if paged else out.drop("witness_off")


def coverage(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Of expected (doc_id, expected: array of units) and received (doc_id, unit): what is missing or unexpected.

    A document without received rows misses everything. Only unit numbers are gathered by document.
    """
    got = received.groupBy("doc_id").agg(F.collect_set("unit").alias("got"), F.count("unit").alias("rows"))
    both = expected.join(got, "doc_id", "left").withColumns({"got": F.coalesce("got", F.array().cast("array<int>")), "rows": F.coalesce("rows", F.lit(0))})
    missing = F.array_sort(F.array_except("expected", "got"))
    extra = F.size(F.array_except("got", "expected")) + F.col("rows") - F.size("got")
    invalid = (F.size("expected") == 0) | (F.size(F.array_distinct("expected")) < F.size("expected")) | F.exists("expected", lambda n: n < 1)
    errors = F.size(missing) + extra + invalid.cast("int")
    return both.select(
        "doc_id", F.size("expected").alias("expected"), F.size("got").alias("received"), missing.alias("missing"),
        errors.cast("int").alias("errors"), F.when(errors > 0, "parcial").otherwise("revisar").alias("status"),
    )


def parse_scope(scope: Column) -> Column:
    """`1-3,7` as sorted distinct units; null for what is not a scope (0, falling or repeated ranges, over 100,000)."""
    number = lambda x, k: F.nullif(F.regexp_extract(x, "^\\s*(\\d+)(?:-(\\d+))?\\s*$", k), F.lit("")).try_cast("int")
    ends = F.transform(F.split(scope, ","), lambda x: F.struct(number(x, 1).alias("a"), F.coalesce(number(x, 2), number(x, 1)).alias("b")))
    bad = F.exists(ends, lambda e: e["a"].isNull() | e["b"].isNull() | (e["a"] < 1) | (e["b"] < e["a"]) | (e["b"] > 100_000))
    units = F.flatten(F.transform(F.filter(ends, lambda e: e["a"].isNotNull() & (e["b"] >= e["a"]) & (e["b"] <= 100_000)), lambda e: F.sequence(e["a"], e["b"])))
    return F.when(bad | (F.size(F.array_distinct(units)) < F.size(units)), F.lit(None)).otherwise(F.array_sort(units))


def sections(blocks: DataFrame) -> DataFrame:
    """Headings with their parent, their section's end and whether another follows: running windows over one document, one value a level."""
    from pyspark.sql import Window

    heads = blocks.filter("kind = 'heading'").select("doc_id", "unit", "block_no", "level", F.btrim(F.regexp_replace("text", HEADING, ""), F.lit(" \t\r\n")).alias("title"))
    order = Window.partitionBy("doc_id").orderBy("unit", "block_no")
    heads = heads.withColumn("ordinal", F.row_number().over(order))
    # Ordinals rise, so the nearest heading of a level is the greatest before and, in falling order, the least behind.
    above = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("doc_id").orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, -1)
    at = lambda level, f, w: F.when(F.col("level") > level, f(F.when(F.col("level") == level, F.col("ordinal"))).over(w))
    parent = F.greatest(*[at(k, F.max, above) for k in range(1, 7)])
    end = F.least(*[F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("ordinal"))).over(below)) for k in range(1, 7)])
    return heads.select("doc_id", "unit", "block_no", "level", "title", "ordinal", parent.alias("parent"), end.alias("next_section"))


def render_units(expected: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id and markdown: units in the order of expected, a pending mark for those that are missing."""
    rows = expected.select("doc_id", F.posexplode("expected").alias("pos", "unit")).join(units, ["doc_id", "unit"], "left")
    body = F.concat(F.lit("\n---\n\n## Página/unidad "), F.col("unit"), F.lit("\n\n"), F.coalesce("text", F.lit("[PENDIENTE: esta unidad no fue recibida.]\n")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", body.alias("body"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["body"]), "").alias("markdown"))


def absent_markers(markers: DataFrame, texts: DataFrame, few: int) -> DataFrame:
    """Rows of markers (marker) that no text of texts contains; a null marker is in none, an empty one in each.

    A marker's words but its first and last stand whole in each text that contains it. The longest pair of neighbours
    among them (or the one that there is) finds candidates, by a join on pairs of words that carries a hash of the text
    and not the text; `contains` over the whole marker decides, on the candidates' texts alone. Markers of one or two
    words are found by their first two characters in the same way. One pass finds candidates, a second asks them. What is joined to is told to be sent to all tasks
    up to few rows.
    """
    words = F.split("marker", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    pairs = F.when(F.size(inner) > 1, F.transform(F.sequence(F.lit(1), F.size(inner) - 1), lambda k: F.array_join(F.slice(inner, k, 2), " "))).otherwise(inner)
    longest = F.array_max(F.transform(pairs, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    known = markers.filter(F.col("marker").isNotNull()).select("marker", longest.alias("gram"), F.least(F.size(inner), F.lit(2)).alias("kind")).distinct()
    known = known.withColumn("gram", F.when(F.col("kind") == 0, F.substring("marker", 1, 2)).otherwise(F.col("gram")))
    keyed = texts.filter(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("key"))
    said, signs = F.split("text", " "), F.split("text", "")
    beside = lambda values, by: F.zip_with(values, F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(by), b))
    grams = {2: beside(said, " "), 1: said, 0: F.concat(beside(signs, ""), signs, F.array(F.lit("")))}
    kinds = sorted(r.kind for r in known.select("kind").distinct().collect())
    if not kinds:
        return markers
    own = known.select("marker", "gram")
    asked = F.broadcast(own) if own.limit(few + 1).count() <= few else own
    said_all = F.array_distinct(F.concat(*[grams[k] for k in kinds]))
    met = keyed.select("key", F.explode(said_all).alias("gram")).join(asked, "gram").select("key", "marker").distinct()
    found = keyed.join(met, "key").filter(F.contains("text", "marker")).select("marker")
    return markers.join(found.distinct(), "marker", "left_anti")
