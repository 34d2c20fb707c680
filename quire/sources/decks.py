"""Decks read whole: slides are unpacked, read and numbered where their archive is, and no row of it is written between or meets another in a join."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .office import Archive
from .ooxml import DeckPart, EdgePart, Part, RelationsPart, SlidePart

PRESENTATION, ITS_RELATIONS = "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"
SLIDE = re.compile(r"ppt/slides/[^/]+\.xml")
SLIDE_RELATIONS = re.compile(r"(ppt/slides/)_rels/([^/]+\.xml)\.rels")
NOTES_PAGE = re.compile(r"ppt/notesSlides/notesSlide[0-9]+\.xml")
PAGE, OWN_NUMBER = re.compile(r"notesSlide([0-9]+)\.xml$"), re.compile(r"([0-9]+)\.xml$")
MOST_INT = (1 << 31) - 1


def _number(pattern: re.Pattern, text: str | None) -> int | None:
    found = pattern.search(text or "")
    digits = found[1].lstrip("0") or "0" if found else ""
    return int(digits) if 0 < len(digits) <= 10 and int(digits) <= MOST_INT else None


class Deck:
    """A deck's parts, one unpacked at a time, and the places of its slides; one that is refused has no parts."""

    def __init__(self, data: bytes | None):
        self.archive = Archive(data)
        self.infos = {i.filename: i for i in self.archive.infos}
        targets, self.places = {}, {}
        for row in self.rows(ITS_RELATIONS, RelationsPart):
            if row["rel"] is not None and row["target"] is not None:
                member = row["target"][1:] if row["target"].startswith("/") else "ppt/" + row["target"]
                targets.setdefault(row["rel"], []).append(member)
        for row in self.rows(PRESENTATION, DeckPart):
            for member in targets.get(row["rel"], ()):
                self.places.setdefault(member, []).append(row["nth"])

    def rows(self, name: str, reader: type[Part]) -> Iterator[dict]:
        """The rows of the part of this name: none if it is not there or damaged."""
        content = self.archive.read(self.infos[name]) if name in self.infos else None
        return (r for r in reader().read(content) if r["kind"] != "damaged") if content is not None else iter(())

    def slides(self, member: str) -> list[int | None]:
        """The places of a slide in the presentation's list, or else its file's number."""
        return self.places.get(member) or [_number(OWN_NUMBER, member)]


def _told(archives: DataFrame, fields: str, rows: Callable[[Deck], Iterable[tuple]]) -> DataFrame:
    """path and these fields of decks (path, content), which travel as an RDD, whose batches are bounded by bytes."""

    def read(decks: Iterable[tuple[str, bytes | None]]) -> Iterator[tuple]:
        for path, data in decks:
            for row in rows(Deck(data)):
                yield path, *row

    found = archives.select("path", "content").rdd.mapPartitions(read)
    return archives.sparkSession.createDataFrame(found, StructType.fromDDL("path string, " + fields), verifySchema=False)


def slide_rows(archives: DataFrame, reader: type[Part], fields: str) -> DataFrame:
    """path, slide and these fields of the reader's rows of slides: as the presentation lists them, or else by the number of their file."""
    own = StructType.fromDDL(fields).names

    def rows(deck: Deck) -> Iterator[tuple]:
        for member in filter(SLIDE.fullmatch, deck.infos):
            places = deck.slides(member)
            for row in deck.rows(member, reader):
                told = [row.get(k) for k in own]
                for n in places:
                    yield n, *told

    return _told(archives, "slide int, " + fields, rows)


def notes_bodies(archives: DataFrame) -> DataFrame:
    """path, slide, body: the first body of the notes page to which a slide is related; pages go by their number."""

    def rows(deck: Deck) -> Iterator[tuple]:
        related, parts = {}, {}
        for name in deck.infos:
            if found := SLIDE_RELATIONS.fullmatch(name):
                for row in deck.rows(name, RelationsPart):
                    if (page := _number(PAGE, row["target"])) is not None:
                        related.setdefault(page, []).extend(deck.slides(found[1] + found[2]))
            elif NOTES_PAGE.fullmatch(name):
                parts.setdefault(_number(PAGE, name), []).append(name)
        for page, slides in related.items():
            bodies = [r for name in parts.get(page, ()) for r in deck.rows(name, BODIES) if r.get("ph") == "body"]
            if bodies:
                body = min(bodies, key=lambda r: r["nth"])["text"]
                for n in slides:
                    yield n, body

    return _told(archives, "slide int, body string", rows)


BODIES = SlidePart.only("shape")
CELLS = SlidePart.only("cell")


def slide_cells(archives: DataFrame) -> DataFrame:
    """path, slide, table_no, row_no, col, text: the cells of the tables on slides."""
    return slide_rows(archives, CELLS, "table_no int, row_no int, col int, text string")


def slide_edges(archives: DataFrame) -> DataFrame:
    """path, slide, connector_id, src, dst, head, tail, src_text, dst_text of the connectors on slides, as `told_edges` takes them."""
    found = slide_rows(archives, EdgePart, "shape_id bigint, src bigint, dst bigint, head string, tail string, src_text string, dst_text string")
    return found.withColumnRenamed("shape_id", "connector_id")
