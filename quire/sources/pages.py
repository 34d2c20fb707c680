"""Web pages to blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import entities

#: Elements that never hold text to read, and those that make a block.
HIDDEN = "(?is)<(script|style|noscript|template)\\b.*?</\\1\\s*>|<!--.*?-->|<!doctype[^>]*>"
BLOCK = "(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|main|aside|blockquote|pre|title|body|head|html|br|hr)\\b[^>]*>"


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no, kind (heading, list or paragraph), level and text: the readable blocks of each page.

    Hidden elements go, block elements part the page, the tags within a block go, and entities are read.
    """
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, " ")
    marked = F.regexp_replace(shown, "(?i)<h([1-6])\\b[^>]*>", "\u0001h$1\u0002")
    marked = F.regexp_replace(marked, "(?i)<li\\b[^>]*>", "\u0001li\u0002")
    marked = F.regexp_replace(F.regexp_replace(marked, BLOCK, "\u0001"), "<[^>]+>", "")
    parts = F.split(marked, "\u0001")
    tag = lambda x: F.regexp_extract(x, "^(h[1-6]|li)\u0002", 1)
    text = lambda x: F.trim(F.regexp_replace(entities(F.regexp_replace(x, "^(h[1-6]|li)\u0002", "")), "(?U)\\s+", " "))
    blocks = F.filter(F.transform(parts, lambda x: F.struct(tag(x).alias("tag"), text(x).alias("text"))), lambda b: b["text"] != "")
    out = pages.select("page_id", F.posexplode(blocks).alias("pos", "b"))
    heading = F.startswith("b.tag", F.lit("h"))
    return out.select(
        "page_id", (F.col("pos") + 1).alias("block_no"), F.when(heading, "heading").when(F.col("b.tag") == "li", "list").otherwise("paragraph").alias("kind"),
        F.when(heading, F.substring("b.tag", 2, 1).cast("int")).alias("level"), F.col("b.text").alias("text"),
    )
