"""EPUB books in their reading order, and CSV files whose dialect is found out."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ranges import dealt_to, shuffled

from .office import tasks_of
from .ooxml import Part, rows_of
from .pages import html_blocks

#: Separators that are tried, rows by which they are judged, the share of rows of one width that one needs.
SEPARATORS, JUDGED, ALIKE = ",;\t|", 50, 0.8
#: Bytes of a file beyond which it is not read, as for an archive's member.
MOST_BYTES = 50_000_000


class PackagePart(Part):
    """Rows of kind root (href: where the package is), item (id, href) and spine (id, nth): a book's container and package."""

    fields = "kind string, id string, href string, nth int, type string"

    def __init__(self):
        super().__init__()
        self.n = 0

    def opened(self, name: str, given: dict[str, str]) -> None:
        if name == "rootfile":
            self.rows.append({"kind": "root", "href": given.get("full-path")})
        elif name == "item":
            self.rows.append({"kind": "item", "id": given.get("id"), "href": given.get("href"), "type": given.get("media-type")})
        elif name == "itemref":
            self.n += 1
            self.rows.append({"kind": "spine", "id": given.get("idref"), "nth": self.n})

    def closed(self, name: str) -> None:
        pass

    def said(self, text: str) -> None:
        pass


def book_chapters(found: DataFrame) -> DataFrame:
    """path, position, member, html: the chapters of books (members: path, member, content) as the spine of their package lists them.

    A chapter that is listed twice comes twice; what the spine names but the book lacks has a null html. The package is
    the container's first root.
    """
    roots = rows_of(found, "^META-INF/container\\.xml$", PackagePart).filter("kind = 'root'").groupBy("path").agg(F.first("href").alias("member"))
    told = rows_of(found, "\\.opf$", PackagePart).join(roots, ["path", "member"], "left_semi")
    folder = F.regexp_extract("member", "^(.*/)?[^/]*$", 1)
    name = F.expr("try_url_decode(regexp_replace(regexp_replace(href, '#.*$', ''), '[+]', '%2B'))")
    items = told.filter("kind = 'item'").select("path", "id", F.concat(F.coalesce(folder, F.lit("")), F.coalesce(name, "href")).alias("member"))
    spine = told.filter("kind = 'spine'").select("path", "id", F.col("nth").alias("position"))
    content = found.filter("content IS NOT NULL").select("path", "member", F.col("content").cast("string").alias("html"))
    tasks = tasks_of(found)
    placed = dealt_to(dealt_to(spine, tasks, "path", "id").join(shuffled(items), ["path", "id"]), tasks, "path", "member")
    return placed.join(shuffled(content), ["path", "member"], "left").select("path", "position", "member", "html")


def book_blocks(found: DataFrame) -> DataFrame:
    """path, position, block_no, kind, level, text: the readable blocks of a book in reading order, numbered through it."""
    chapters = book_chapters(found).withColumn("page_id", F.struct("path", "position"))
    blocks = html_blocks(chapters.select("page_id", "html"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("position", "own"))
    out = dealt_to(blocks.select("page_id.path", "page_id.position", F.col("block_no").alias("own"), "kind", "level", "text"), tasks_of(found), "path")
    return out.withColumn("block_no", nth).select("path", "position", "block_no", "kind", "level", "text")


def separator_of(text: str) -> str:
    """The separator by which most of the first rows have one width of two or more; a comma if none is good enough."""
    best, found = (0.0, 0), ","
    for sign in SEPARATORS:
        widths = []
        for row in csv.reader(io.StringIO(text, newline=""), delimiter=sign):
            if row:
                widths.append(len(row))
            if len(widths) == JUDGED:
                break
        width, n = Counter(widths).most_common(1)[0] if widths else (1, 0)
        rank = (n / max(len(widths), 1), width)
        if width > 1 and rank[0] >= ALIKE and rank > best:
            best, found = rank, sign
    return found


def csv_rows(found: DataFrame) -> DataFrame:
    """path, separator, row_no, cells, fault of CSV files (path, content): a row a record, empty lines left out.

    Quoted cells may hold separators, quotes and line ends. A file that is too large, not UTF-8, or whose quotes do not
    close within a cell's limit is one row with its fault. Cells are as they stand; rows keep their own width.
    """
    schema = pa.schema([("path", pa.string()), ("separator", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("fault", pa.string())])

    def told(path: str, content: bytes | None) -> Iterator[tuple]:
        if content is None or len(content) > MOST_BYTES:
            yield path, None, None, None, "too large" if content else "no content"
            return
        try:
            text = content.decode("utf-8-sig")
            sign = separator_of(text[: 1 << 16])
            n = 0
            for row in csv.reader(io.StringIO(text, newline=""), delimiter=sign):
                if row:
                    n += 1
                    yield path, sign, n, row, None
        except UnicodeDecodeError:
            yield path, None, None, None, "not utf-8"
        except csv.Error:
            yield path, None, None, None, "damaged"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for row in told(path.as_py(), content.as_py()):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return found.select("path", "content").mapInArrow(run, "path string, separator string, row_no int, cells array<string>, fault string")
