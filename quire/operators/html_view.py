"""The HTML view of a package: tokens become HTML by Spark's functions, text is escaped first and only what a list allows comes back.

Code spans, links and images are set aside while the rest of a text is worked on: each leaves a sign, and comes back
where its sign stands. Where a link leads is a policy: an anchor, another file of the package, the web; nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import column_letter, sub
from quire.sources.markdown import tokens_of

VERSION = 1
#: Marks of doubt and their classes, wide tables, words of the view.
DOUBT = r"(?i)\[(verificar|ilegible|pendiente|sin cach[eé])\b([^\]\n]*)\]"
WIDE = 9
VIEW = "vista.html"
#: Signs that stand for what is set aside; texts hold none, as control characters go first.
CODE, LINK, END, MARK = "\u0001", "\u0002", "\u0003", "\u0004"
POINTER = r"(!?)\[([^\]]*)\]\((?:&lt;([^&]+)&gt;|([^)\s]+))\)"


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def restored(text: Column, sign: str, made: Callable[[Column, Column], Column]) -> Column:
    """text with made(what follows a sign, the sign's number from 1) in place of each sign and its piece."""
    pieces = F.split(text, sign)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(made(p, i))), "")


def target_kind(target: Column, assets: Column) -> Column:
    """anchor, external, ok, outside or absent. A path is of the package if it climbs no higher than its folder and is among assets."""
    steps = F.filter(F.split(target, "/"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")))["low"]
    return (
        F.when(F.startswith(target, F.lit("#")), "anchor").when(F.rlike(target, F.lit("(?i)^[a-z][a-z0-9+.-]*:")), "external")
        .when(F.startswith(target, F.lit("/")) | (depth < 0), "outside").when(F.array_contains(assets, target), "ok").otherwise("absent")
    )


def _pointer(image: Column, text: Column, target: Column, assets: Column) -> Column:
    """A link or an image, by where it leads; target is as written, text is HTML already."""
    kind, shown = target_kind(target, assets), escaped(target)
    lost = F.when(kind == "external", "imagen remota no cargada").when(kind == "outside", "imagen fuera del paquete").otherwise("imagen ausente")
    picture = F.when(kind == "ok", F.concat(F.lit('<img src="'), shown, F.lit('" alt="'), text, F.lit('" loading="lazy">'))).otherwise(F.concat(F.lit('<span class="falta">'), lost, F.lit(": "), shown, F.lit("</span>")))
    web = F.rlike(target, F.lit("(?i)^https?:"))
    rel = F.when(kind == "external", ' rel="noopener noreferrer" target="_blank"').otherwise("")
    link = F.when((kind == "external") & ~web, shown).otherwise(F.concat(F.lit('<a href="'), shown, F.lit('"'), rel, F.lit(">"), text, F.lit("</a>")))
    return F.when(image == "!", picture).otherwise(link)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often, and in however many lambdas, body uses it."""
    return F.transform(F.array(value), body)[0]


def inline(text: Column, assets: Column) -> Column:
    """A text as HTML, with the sign MARK before each mark of doubt (see numbered)."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08]", "")
    said = lambda plain, k: F.regexp_extract_all(plain, F.lit(POINTER), F.lit(k))
    back = lambda target: F.replace(F.replace(F.replace(F.replace(target, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))

    def shown(plain: Column) -> Column:
        s = sub(plain, POINTER, f"{LINK}$2{END}")
        for sign in ("\\*\\*", "__"):
            s = sub(s, f"{sign}(.+?){sign}", "<strong>$1</strong>")
        s = sub(s, r"(?<![\w*])\*(?!\s)(.+?)(?<!\s)\*(?![\w*])", "<em>$1</em>")
        s = sub(s, DOUBT, f"{MARK}$0")
        s = sub(sub(s, "&lt;br\\s*/?&gt;", "<br>"), "&lt;(/?)u&gt;", "<$1u>")
        return sub(s, "&amp;(#\\d{1,6}|#x[0-9a-fA-F]{1,6}|lt|gt|amp|quot|nbsp);", "&$1;")

    def linked(plain: Column) -> Column:
        targets = F.zip_with(said(plain, 3), said(plain, 4), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
        made = lambda x: restored(x["s"], LINK, lambda p, i: bound(F.split_part(p, F.lit(END), F.lit(1)), lambda t: F.concat(_pointer(F.get(x["images"], i - 1), t, back(F.get(x["targets"], i - 1)), assets), F.substring(p, F.length(t) + 2, F.length(p)))))
        return F.when(F.contains(plain, F.lit("](")), bound(F.struct(shown(plain).alias("s"), said(plain, 1).alias("images"), targets.alias("targets")), made)).otherwise(shown(plain))

    def coded(raw: Column) -> Column:
        plain = sub(escaped(sub(raw, "`[^`]+`", CODE)), r"\\([\\`*_{}\[\]()#+\-.!|>~])", "$1")
        codes = F.regexp_extract_all(raw, F.lit("`([^`]+)`"), F.lit(1))
        made = lambda x: restored(x["s"], CODE, lambda p, i: F.concat(F.lit("<code>"), escaped(F.get(x["codes"], i - 1)), F.lit("</code>"), p))
        return F.when(F.contains(raw, F.lit("`")), bound(F.struct(bound(plain, linked).alias("s"), codes.alias("codes")), made)).otherwise(bound(plain, linked))

    return bound(raw, coded)


def numbered(html: Column, before: Column) -> Column:
    """html with its marks of doubt as elements, numbered on from those before."""
    kind = lambda p: F.regexp_replace(F.translate(F.lower(F.regexp_extract(p, DOUBT, 1)), "é ", "e"), "sincache", "pendiente")
    return restored(html, MARK, lambda p, i: F.concat(F.lit('<mark class="'), kind(p), F.lit('" id="m'), (before + i).cast("string"), F.lit('">'), F.regexp_extract(p, DOUBT, 0), F.lit("</mark>"), F.substring(p, F.length(F.regexp_extract(p, DOUBT, 0)) + 1, F.length(p))))


def _table(rows: Column, head: Column, width: Column, assets: Column) -> Column:
    """A table; wide ones tell their size, their empty columns are marked."""
    body = F.when(head, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    columns = F.sequence(F.lit(0), width - 1)
    return bound(body, lambda own: bound(F.transform(columns, lambda i: F.forall(own, lambda r: F.get(r, i) == "")), lambda empty: _laid_out(own, empty, rows, head, width, columns, assets)))


def _laid_out(body: Column, empty: Column, rows: Column, head: Column, width: Column, columns: Column, assets: Column) -> Column:
    """body: the rows beneath the header; empty: which columns have no text in them."""
    blank = F.aggregate(body, F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: c == "")))
    share = F.round(100 * blank / F.greatest(width * F.size(body), F.lit(1))).cast("int")
    wide = width > WIDE
    classes = lambda names: F.when(F.array_size(F.array_compact(names)) > 0, F.concat(F.lit(' class="'), F.array_join(names, " "), F.lit('"'))).otherwise("")
    hollow = lambda i: F.when(F.get(empty, i), "cv")
    title = lambda c: F.when(wide & (c != ""), F.concat(F.lit(' title="'), escaped(F.substring(c, 1, 300)), F.lit('"'))).otherwise("")
    cell = lambda c, i: F.concat(F.lit("<td"), classes(F.array(F.when(c == "", "v"), hollow(i))), title(c), F.lit(">"), inline(c, assets), F.lit("</td>"))
    named = F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c, i: F.concat(F.lit('<th scope="col"'), classes(F.array(hollow(i))), F.lit(">"), inline(c, assets), F.lit("</th>"))), "")
    lettered = F.array_join(F.transform(columns, lambda i: F.concat(F.lit('<th scope="col"'), classes(F.array(F.lit("letra"), hollow(i))), F.lit(">"), column_letter(i + 1), F.lit("</th>"))), "")
    header = F.when(head, named).when(wide, lettered)
    told = F.concat(F.lit('<div class="tabla-meta">'), F.size(body).cast("string"), F.lit(" filas × "), width.cast("string"), F.lit(" columnas · "), share.cast("string"), F.lit(" % vacías</div>"))
    return F.concat(
        F.lit('<div class="tabla'), F.when(wide, ' ancha').otherwise(""), F.lit('">'), F.when(wide, told).otherwise(""), F.lit("<table>"),
        F.coalesce(F.concat(F.lit("<thead><tr>"), header, F.lit("</tr></thead>")), F.lit("")), F.lit("<tbody>"),
        F.array_join(F.transform(body, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), ""), F.lit("</tbody></table></div>"),
    )


def token_html(assets: Column) -> Column:
    """A token as HTML, marks of doubt by their sign."""
    c, kind = F.col, F.col("kind")
    wrap = lambda before, inside, after: F.concat(F.lit(before), inside, F.lit(after))
    level = F.least("level", F.lit(6)).cast("string")
    unit = F.coalesce(F.concat(F.lit(' data-unidad="'), "unit", F.lit('"')), F.lit(""))
    items = F.array_join(F.transform(F.get("rows", F.lit(0)), lambda x: wrap("<li>", inline(x, assets), "</li>")), "")
    tag = F.when(c("flag"), "ol").otherwise("ul")
    sheet = F.concat(
        F.lit('<details class="hoja'), F.when(c("flag"), " oculta").otherwise(""), F.lit('"'), F.when(c("unit") == "open", " open").otherwise(""), F.lit('><summary><h2 id="'), "id", F.lit('">Hoja: '), escaped(c("text")), F.lit("</h2>"),
        F.when(c("flag"), '<span class="badge">oculta</span>').otherwise(""), F.lit('<span class="stats">'), escaped(c("note")), F.lit('</span></summary><div class="contenido">'),
    )
    return (
        F.when(kind == "paragraph", wrap("<p>", inline(c("text"), assets), "</p>"))
        .when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(' id="'), "id", F.lit('"'), unit, F.lit(">"), inline(c("text"), assets), F.lit("</h"), level, F.lit(">")))
        .when(kind == "code", wrap("<pre><code>", escaped(c("text")), "</code></pre>")).when(kind == "rule", F.lit("<hr>"))
        .when(kind == "figures", wrap('<p class="meta">', inline(c("text"), assets), "</p>"))
        .when(kind == "list", F.concat(F.lit("<"), tag, F.lit(">"), items, F.lit("</"), tag, F.lit(">")))
        .when(kind == "quote", F.when(c("flag"), '<blockquote class="figura">').otherwise("<blockquote>")).when(kind == "quote_end", F.lit("</blockquote>"))
        .when(kind == "table", _table(c("rows"), c("flag"), c("level"), assets)).when(kind == "sheet", sheet).when(kind == "sheet_end", F.lit("</div></details>"))
    )


def rendered(documents: DataFrame) -> DataFrame:
    """doc_id, html, toc, sheets, tables, marks of documents (doc_id, text, assets: the package's own files).

    Marks are numbered through a document in the order of its tokens; toc tells headings and sheets (level, id, text,
    hidden, figures). A document without a block has an empty html.
    """
    tokens = tokens_of(documents.select("doc_id", "text"))
    with_assets = tokens.join(documents.select("doc_id", "assets"), "doc_id") if "assets" in documents.columns else tokens.withColumn("assets", F.array().cast("array<string>"))
    told = with_assets.withColumn("html", token_html(F.coalesce("assets", F.array().cast("array<string>")))).withColumn("marks", F.length("html") - F.length(F.replace("html", F.lit(MARK), F.lit(""))))
    before = F.coalesce(F.sum("marks").over(Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = told.withColumn("html", numbered(F.col("html"), before))
    entry = F.when(F.col("kind").isin("heading", "sheet"), F.struct("nth", F.least("level", F.lit(4)).alias("level"), "id", F.when(F.col("kind") == "sheet", F.concat(F.lit("Hoja: "), "text")).otherwise(F.col("text")).alias("text"), ((F.col("kind") == "sheet") & F.coalesce("flag", F.lit(False))).alias("hidden"), F.coalesce("note", F.lit("")).alias("figures")))
    by_doc = done.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "html"))), lambda x: x["html"]), "\n").alias("html"), F.array_sort(F.collect_list(entry)).alias("toc"),
        F.count_if(F.col("kind") == "sheet").alias("sheets"), F.count_if(F.col("kind") == "table").alias("tables"), F.sum("marks").alias("marks"),
    )
    none = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    return documents.select("doc_id").join(by_doc, "doc_id", "left").select("doc_id", F.coalesce("html", F.lit("")).alias("html"), "toc", *[none(c, "bigint") for c in ("sheets", "tables", "marks")])


def stamp(text: Column) -> Column:
    """The first line of a view: which version made it of which content."""
    return F.concat(F.lit(f"<!-- quire view v{VERSION} md="), F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(" -->"))


def views_due(documents: DataFrame, views: DataFrame, declared: DataFrame) -> DataFrame:
    """documents with state: `written` if their view (doc_id, stamp) has their stamp, `refused` if the package itself declares a file of that name, else `due`."""
    old = views.select("doc_id", F.col("stamp").alias("old")).dropDuplicates(["doc_id", "old"])
    own = stamp(F.col("text"))
    same = documents.join(old, "doc_id", "left").groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("old") == own, F.lit(False))).alias("same"))
    mine = declared.filter(F.col("name") == VIEW).select("doc_id").distinct().withColumn("mine", F.lit(True))
    state = F.when(F.col("mine"), "refused").when(F.col("same"), "written").otherwise("due")
    return documents.join(same, "doc_id").join(mine, "doc_id", "left").withColumn("state", state).drop("same", "mine")


def pages(documents: DataFrame) -> DataFrame:
    """doc_id, stamp, page: whole HTML pages of documents (doc_id, title, text, assets): the stamp, the way through it, the content."""
    own = rendered(documents)
    link = lambda t: F.concat(F.lit('<a class="n'), t["level"].cast("string"), F.when(t["hidden"], " oculta").otherwise(""), F.lit('" href="#'), t["id"], F.lit('">'), escaped(t["text"]), F.when(t["figures"] != "", F.concat(F.lit('<span class="st">'), escaped(t["figures"]), F.lit("</span>"))).otherwise(""), F.lit("</a>"))
    ways = F.array_join(F.transform(F.coalesce("toc", F.array().cast(own.schema["toc"].dataType)), link), "")
    policy = "default-src 'none'; img-src 'self' data:; style-src 'unsafe-inline'"
    page = F.concat(
        "stamp", F.lit('\n<!doctype html>\n<html lang="es"><head><meta charset="utf-8">\n<meta http-equiv="Content-Security-Policy" content="' + policy + '">\n<title>'), escaped(F.coalesce("title", F.lit(""))),
        F.lit('</title></head><body>\n<nav class="indice"><b>'), F.size(F.coalesce("toc", F.array().cast(own.schema["toc"].dataType))).cast("string"), F.lit(" secciones · "), F.col("sheets").cast("string"), F.lit(" hojas · "), F.col("tables").cast("string"), F.lit(" tablas</b>"),
        ways, F.lit('</nav>\n<main class="doc">'), "html", F.lit("</main>\n</body></html>"),
    )
    return own.join(documents.select("doc_id", "title", stamp(F.col("text")).alias("stamp")), "doc_id").select("doc_id", "stamp", page.alias("page"))
