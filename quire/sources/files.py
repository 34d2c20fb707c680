"""File inventory and content sniffing: what a file is, told by its bytes; the name only helps for text."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: How files of a kind begin. None is the beginning of another, so their order says nothing.
SIGNATURES = (
    (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"II*\0", "tif"), (b"MM\0*", "tif"), (b"\xff\xd8\xff", "jpg"), (b"\x89PNG\r\n\x1a\n", "png"),
    (b"%PDF", "pdf"), (b"AC10", "dwg"), (b"AutoCAD Binary DXF", "dxf"), (b"\xd0\xcf\x11\xe0", "office-legacy"),
)
WEBP = (b"RIFF", b"WEBP")
ARCHIVE = b"PK"
#: Folders that an inventory skips.
SKIPPED = "/(\\.git|\\.claude|\\.codex|\\.venv|__pycache__)/"
#: The folder of an Office archive that tells its kind.
OFFICE = {"word": "docx", "xl": "xlsx", "ppt": "pptx", "visio": "vsdx"}
TEXT = ("txt", "md", "csv", "json", "html", "xml")
#: A drawing in text is pairs of lines, a group code and its value: comments have code 999, a section begins with 0, SECTION.
COMMENT, BEGINS = "999", ("0", "SECTION")
HEAD = 1024
MARK = b"\xef\xbb\xbf"
#: A text of nothing but white space, the separators U+001C to U+001F included.
NOTHING = "(?U)^[\\s\\x1c-\\x1f]*$"


@F.pandas_udf(StringType())
def zip_kind(content: pd.Series) -> pd.Series:
    """What a ZIP archive holds, by its members' prefixes."""

    def told(data: bytes) -> str:
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except (zipfile.BadZipFile, ValueError):
            return "zip-damaged"
        kinds = {OFFICE[top] for top, inside, _ in (n.partition("/") for n in names) if inside and top in OFFICE}
        binary = "xl/workbook.bin" in names
        return "xlsb" if binary else "zip" if not kinds else kinds.pop() if len(kinds) == 1 else "zip-ambiguous"

    return content.map(told)


def _readable(content: Column) -> Column:
    """Whether the head is UTF-8, but for a character that the head cuts."""
    head = F.substring(content, 1, HEAD)
    whole = lambda n: F.is_valid_utf8(F.substring(content, 1, n).cast("string"))
    cut = F.octet_length(content) > HEAD
    valid = F.is_valid_utf8(head.cast("string")) | (cut & (whole(HEAD - 1) | whole(HEAD - 2) | whole(HEAD - 3)))
    return valid & (F.instr(F.decode(head, "ISO-8859-1"), "\u0000") == 0)


def _drawing(head: Column) -> Column:
    """Whether the first pair that is no comment begins a section. Blank lines before a code, or before the section's name, say nothing."""
    lines = F.split(F.replace(head, F.lit("\r\n"), F.lit("\n")), "\n")

    def step(state: Column, line: Column) -> Column:
        said, settled = F.btrim(line, F.lit(" \t\r\x0b\x0c")), state.isin("yes", "no")
        begins = F.when(F.regexp_extract(said, "^(\\w*)", 1) == BEGINS[1], "yes").otherwise("no")
        code = F.when(said == COMMENT, "comment").when(said == BEGINS[0], "begins").otherwise("no")
        return F.when(settled, state).when(state == "comment", "code").when(said == "", state).when(state == "begins", begins).otherwise(code)

    return F.aggregate(lines, F.lit("code"), step) == "yes"


def kind_of(path: Column, content: Column) -> Column:
    """The kind of a file; archives (the only ones that need a parser) are told by their member names."""
    begins = lambda sign, at=1: F.substring(content, at, len(sign)) == F.lit(sign)
    suffix = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    kind = F.when(F.octet_length(content) == 0, "empty")
    for sign, name in SIGNATURES:
        kind = kind.when(begins(sign), name)
    kind = kind.when(begins(WEBP[0]) & begins(WEBP[1], 9), "webp").when(begins(ARCHIVE), "zip")
    kind = kind.when(_drawing(F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")), "dxf")
    return kind.when(_readable(content), F.when(suffix.isin(*TEXT), suffix).otherwise("text")).otherwise("unsupported")


def sniffed(found: DataFrame) -> DataFrame:
    """path, bytes, kind and sha256 of files (path, content)."""
    told = found.withColumn("kind", kind_of(F.col("path"), F.col("content")))
    zips = told.filter("kind = 'zip'").withColumn("kind", zip_kind("content"))
    both = told.filter("kind <> 'zip'").unionByName(zips)
    return both.select("path", F.octet_length("content").cast("long").alias("bytes"), "kind", F.sha2("content", 256).alias("sha256"))


def text_units(found: DataFrame) -> DataFrame:
    """path, title, sha256, unit, state and text of text files (path, content), each whole file a unit of its own.

    state is `unit`, `blank` (nothing but white space, or no content) or `not utf-8`; only a unit has a text, without
    the mark of its encoding, and a number. The digest is of the bytes as they are.
    """
    body = F.when(F.substring("content", 1, len(MARK)) == F.lit(MARK), F.expr(f"substring(content, {len(MARK) + 1})")).otherwise(F.col("content")).cast("string")
    read = found.select("path", F.regexp_extract("path", "([^/]+?)(?:\\.[^./]*)?$", 1).alias("title"), F.sha2("content", 256).alias("sha256"), body.alias("text"))
    blank = F.col("text").isNull() | F.rlike("text", F.lit(NOTHING))
    state = F.when(~F.is_valid_utf8("text"), "not utf-8").when(blank, "blank").otherwise("unit")
    fine = F.col("state") == "unit"
    return read.withColumn("state", state).select("path", "title", "sha256", F.when(fine, 1).alias("unit"), "state", F.when(fine, F.col("text")).alias("text"))


def inventory(spark: SparkSession, folder: str, limit: int = 200) -> DataFrame:
    """path, length, modificationTime of the first files below a folder by path, skipped folders left out, and truncated: whether there are more than limit.

    The limit is this operator's report size, as a listing for people.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(~F.rlike("path", F.lit(SKIPPED)))
    first = found.select("path", "length", "modificationTime").orderBy("path").limit(limit + 1)
    numbered = first.withColumns({"nth": F.row_number().over(Window.orderBy("path")), "truncated": F.count(F.lit(1)).over(Window.partitionBy()) > limit})
    return numbered.filter(F.col("nth") <= limit).drop("nth")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, gone, changed) of two listings (path, length, modificationTime); a file that keeps both is not read again."""
    old = before.select("path", F.struct("length", "modificationTime").alias("old"))
    both = old.join(after.select("path", F.struct("length", "modificationTime").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def samples(part: DataFrame) -> DataFrame:
    """A file a part, with a known beginning: signatures, text and damage in turn."""
    heads = [*(h for h, _ in SIGNATURES), b"RIFF\0\0\0\0WEBP", b"\n0\nSECTION\n", b"PK\x03\x04", b"", b"\xff\0\xfe", "ño".encode(), b"abc"]
    at = (F.col("p_partkey") % len(heads)).cast("int")
    name = F.concat(F.lit("/in/"), "p_partkey", F.get(F.array(*map(F.lit, (".txt", ".bin", ".MD", ""))), (F.col("p_partkey") % 4).cast("int")))
    return part.select(name.alias("path"), F.get(F.array(*map(F.lit, heads)), at).alias("content"))
