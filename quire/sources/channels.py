"""What Word and slides say beside their body: notes, comments, headers, links, formulas, tables and speakers' notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import md_text, ooxml_text
from quire.operators.ranges import dealt_to, shuffled

from . import decks
from .office import RELATIONS, WORD_BODY, _slide_rows, _xml, numbered_slides, tasks_of
from .ooxml import MARGINS, NOTES, SlidePart, WordPart, rows_of

CHANNELS = "^word/(?:(?:footnotes|endnotes|comments)|(?:header|footer)\\d*)\\.xml$"
SPEAKER = "> **Notas del orador:** "


def word_channels(found: DataFrame) -> DataFrame:
    """path, member, channel (footnote, endnote, comment, header, footer), nth, id, author, text.

    Separators of notes and parts without text are no rows; a header or footer is one row a member, and
    paragraphs are lines. Only narrow rows leave the scan: nothing is shuffled.
    """
    rows = rows_of(found, CHANNELS, WordPart.only(*NOTES, *MARGINS.values())).filter(F.col("kind").isin(*NOTES, "header", "footer"))
    kept = rows.filter("type IS NULL OR kind NOT IN ('footnote', 'endnote')")
    return kept.select("path", "member", F.col("kind").alias("channel"), "nth", "id", "author", "text").filter(F.trim(F.regexp_replace("text", "\\s+", "")) != "")


def word_links(found: DataFrame) -> DataFrame:
    """path, nth, text, target of the links of Word bodies: related targets by (path, id), inner ones as #anchor.

    A link whose relation is missing has a null target.
    """
    links = rows_of(found, WORD_BODY, WordPart.only("link")).filter("kind = 'link'").select("path", "nth", "text", "rel", "anchor")
    targets = _xml(found, "^word/_rels/document\\.xml\\.rels$", RELATIONS).select("path", F.inline("x.Relationship")).select("path", F.col("_Id").alias("rel"), F.col("_Target").alias("outer"))
    told = links.join(targets, ["path", "rel"], "left")
    mark = F.concat(F.lit("#"), "anchor")
    return told.select("path", "nth", "text", F.when(F.col("rel").isNull(), mark).otherwise(F.concat("outer", F.coalesce(mark, F.lit("")))).alias("target"))


def word_formulas(found: DataFrame) -> DataFrame:
    """path, nth, text of the formulas of Word bodies, in order, each on one line; no other rows of a body are held or handed on."""
    return rows_of(found, WORD_BODY, WordPart.only("formula")).filter("kind = 'formula'").select("path", "nth", "text")


def slide_tables(found: DataFrame) -> DataFrame:
    """path, slide, table_no, row_no, col, text: the cells of the tables on slides, merged ones as they are written."""
    return _slide_rows(found, SlidePart.only("cell")).filter("kind = 'cell'").select("path", "slide", "table_no", "row_no", "col", ooxml_text(F.col("text")).alias("text"))


def deck_tables(archives: DataFrame) -> DataFrame:
    """slide_tables of decks (path, content), each read in one pass."""
    return decks.slide_cells(archives).withColumn("text", ooxml_text(F.col("text")))


def slide_notes(found: DataFrame) -> DataFrame:
    """path, slide, text, quoted: what the speaker's notes of a slide say, found over the slide's relations.

    Only the body of a notes page counts, not its number or date; notes without text are no rows. `quoted` is
    Markdown with every line inside the quotation.
    """
    page = lambda c: F.regexp_extract(c, "notesSlide(\\d+)\\.xml$", 1).try_cast("int")
    related = _xml(found, "^ppt/slides/_rels/[^/]+\\.xml\\.rels$", RELATIONS).select("path", F.regexp_replace("member", "_rels/|\\.rels$", "").alias("member"), F.inline("x.Relationship"))
    related = numbered_slides(related.select("path", "member", page("_Target").alias("page")).filter("page IS NOT NULL"), found)
    shapes = rows_of(found, "^ppt/notesSlides/notesSlide\\d+\\.xml$", SlidePart.only("shape")).filter("kind = 'shape' AND ph = 'body'")
    shapes = dealt_to(shapes.select("path", page("member").alias("page"), "nth", "text"), tasks_of(found), "path", "page")
    pages = shapes.groupBy("path", "page").agg(F.min_by("text", "nth").alias("body"))
    told = _said(pages).join(shuffled(related), ["path", "page"])
    return told.select("path", "slide", "text", _quoted(F.col("text")).alias("quoted"))


def deck_notes(archives: DataFrame) -> DataFrame:
    """slide_notes of decks (path, content), each read in one pass."""
    return _said(decks.notes_bodies(archives)).select("path", "slide", "text", _quoted(F.col("text")).alias("quoted"))


def _said(pages: DataFrame) -> DataFrame:
    """Notes pages whose body says something, with its text."""
    text = F.regexp_replace(ooxml_text(F.col("body")), "^\\s+|\\s+\\z", "")
    return pages.withColumn("text", text).drop("body").filter("text <> ''")


def _quoted(text: Column) -> Column:
    lines = F.transform(F.split(md_text(text), "\n"), lambda line, n: F.concat(F.when(n == 0, F.lit(SPEAKER)).when(F.trim(line) == "", F.lit(">")).otherwise(F.lit("> ")), F.when((n == 0) | (F.trim(line) != ""), line).otherwise(F.lit(""))))
    return F.array_join(lines, "\n")
