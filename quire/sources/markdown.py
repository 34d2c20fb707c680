"""Markdown documents as flat tokens: the block structure, line by line, with a stack of what is open.

The automaton holds a document's lines and knows blocks only; inline text is Spark's (see operators/html_view).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions.text import ACCENTS, PLAIN

TOKEN = "nth int, kind string, level int, text string, rows array<array<string>>, flag boolean, id string, unit string, note string"
#: Tokens, and characters of documents, after which a task hands tokens on.
HELD_TOKENS, HELD_CHARS = 2_000, 4_000_000
#: Quotes within quotes beyond this depth are text.
DEEPEST = 16
#: Fixed values of the format: a sheet's heading, its mark if hidden, the line of its figures, a unit's anchor.
SHEET, HIDDEN, FIGURES, UNIT = "Hoja:", "*(oculta)*", re.compile(r"filas \d+ · columnas (?:con dato|usadas) \d+"), re.compile(r'<a id="(unidad-\d+)"></a>')
RULER = re.compile(r":?-{2,}:?")
BARE = str.maketrans(ACCENTS, PLAIN)


def fence_of(line: str) -> str | None:
    """The sign of a fence that this line opens or closes."""
    body = line.lstrip(" \t")
    return body[0] if len(line) - len(body) <= 3 and body[:3] in ("```", "~~~") else None


def heading_of(line: str) -> tuple[int, str] | None:
    signs = line[:7].split(" ")[0].split("\t")[0]
    if not signs or len(signs) > 6 or signs.strip("#") or len(line) == len(signs):
        return None
    text = line[len(signs) :].strip(" \t")
    cut = text.rstrip("#").rstrip(" \t")
    return (len(signs), cut or text) if text else None


def item_of(line: str) -> tuple[str, str] | None:
    """Marker and text of a list's line."""
    marker, _, text = line.strip(" \t").replace("\t", " ", 1).partition(" ")
    if not marker or " " not in line.strip(" \t").replace("\t", " ") and marker == line.strip():
        return None
    numbered = marker[-1] in ".)" and marker[:-1].isdigit() and marker[:-1].isascii() and len(marker) <= 10
    return (marker, text.lstrip(" \t")) if marker in ("-", "*", "+") or numbered else None


def rule_of(line: str) -> bool:
    body = line.strip(" \t")
    return len(body) >= 3 and body[0] in "-*_" and not body.strip(body[0]) and len(line) - len(line.lstrip(" \t")) <= 3


def quoted(line: str) -> str | None:
    """The inside of a quotation's line."""
    body = line.lstrip(" \t")
    if not body.startswith(">") or len(line) - len(body) > 3:
        return None
    return body[2:] if body[1:2] == " " else body[1:]


def cells_of(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


class Blocks:
    """Tokens of one document."""

    def __init__(self):
        self.tokens, self.ids, self.unit, self.opened = [], set(), None, False

    def emit(self, kind: str, **told: object) -> None:
        self.tokens.append({"nth": len(self.tokens), "kind": kind, **told})

    def name(self, text: str) -> str:
        """An id for a heading that no other has."""
        base = re.sub(r"[^a-z0-9]+", "-", text.translate(BARE).lower()).strip("-") or "s"
        found, n = base, 2
        while found in self.ids:
            found, n = f"{base}-{n}", n + 1
        self.ids.add(found)
        return found

    def run(self, lines: list[str], depth: int = 0) -> None:
        at = 0
        while at < len(lines):
            at = self.block(lines, at, depth)

    def block(self, lines: list[str], at: int, depth: int) -> int:
        """Emit the block that begins at this line; where the next one may begin."""
        line = lines[at]
        said = line.strip()
        anchor = UNIT.fullmatch(said)
        if not said or anchor:
            self.unit = anchor.group(1) if anchor else self.unit
            return at + 1
        if sign := fence_of(line):
            end = self.until(lines, at + 1, lambda x: fence_of(x) == sign and not x.strip().strip(sign))
            self.emit("code", text="\n".join(lines[at + 1 : end]))
            return end + 1
        if found := heading_of(line):
            return self.sheet(lines, at, found[1], depth) if found[1].startswith(SHEET) and found[1][len(SHEET) :].strip() else self.heading(*found) or at + 1
        if rule_of(line) or FIGURES.match(said):
            self.emit("rule" if rule_of(line) else "figures", text=said)
            return at + 1
        if said.startswith("|"):
            end = self.until(lines, at, lambda x: not x.strip().startswith("|"))
            self.table([cells_of(x) for x in lines[at:end]])
            return end
        if quoted(line) is not None and depth < DEEPEST:
            end = self.until(lines, at, lambda x: quoted(x) is None)
            inside = [quoted(x) for x in lines[at:end]]
            self.emit("quote", flag=inside[0].lstrip().startswith("🖼️"))
            self.run(inside, depth + 1)
            self.emit("quote_end")
            return end
        if item_of(line):
            return self.list(lines, at)
        end = self.until(lines, at + 1, lambda x: not x.strip() or x.strip().startswith("|") or heading_of(x) or rule_of(x) or quoted(x) is not None or item_of(x))
        self.emit("paragraph", text=" ".join(x.strip() for x in lines[at:end]))
        return end

    @staticmethod
    def until(lines: list[str], at: int, stop: Callable[[str], object]) -> int:
        while at < len(lines) and not stop(lines[at]):
            at += 1
        return at

    def heading(self, level: int, text: str) -> None:
        self.emit("heading", level=level, text=text, id=self.name(text), unit=self.unit)
        self.unit = None

    def sheet(self, lines: list[str], at: int, text: str, depth: int) -> int:
        """A sheet is what stands up to the next heading of the first two levels or the next unit."""
        end = self.until(lines, at + 1, lambda x: UNIT.fullmatch(x.strip()) or (heading_of(x) or (9,))[0] <= 2)
        inside, name = lines[at + 1 : end], text[len(SHEET) :].strip()
        hidden = name.endswith(HIDDEN)
        name = name.removesuffix(HIDDEN).rstrip() if hidden else name
        rows = sum(x.strip().startswith("|") for x in inside)
        figures = next((x.strip() for x in inside if FIGURES.match(x.strip())), f"{max(0, rows - 2)} filas" if rows else "sin filas")
        self.emit("sheet", level=2, text=name, flag=hidden, id=self.name("hoja-" + name), note=figures, unit="open" if not hidden and not self.opened else None)
        self.opened |= not hidden
        self.run(inside, depth)
        self.emit("sheet_end")
        return end

    def table(self, rows: list[list[str]]) -> None:
        head = len(rows) > 1 and all(RULER.fullmatch(c) for c in rows[1])
        width = max(map(len, rows))
        kept = [r + [""] * (width - len(r)) for r in (rows[:1] + rows[2:] if head else rows)]
        self.emit("table", level=width, flag=head, rows=kept)

    def list(self, lines: list[str], at: int) -> int:
        """Items of any depth; a deeper line without a marker goes on with the last one."""
        first = item_of(lines[at])
        indent = len(lines[at][: len(lines[at]) - len(lines[at].lstrip(" \t"))].expandtabs(4))
        items = []
        while at < len(lines):
            own = item_of(lines[at])
            if own:
                items.append([own[1]])
            elif lines[at].strip() and len(lines[at]) - len(lines[at].lstrip(" \t")) > indent:
                items[-1].append(lines[at].strip())
            else:
                break
            at += 1
        self.emit("list", flag=first[0] not in ("-", "*", "+"), rows=[[" ".join(x) for x in items]])
        return at


def tokens_of(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the TOKEN columns of Markdown documents, in the order of nth. Null is no token; line ends are read as one.

    Documents are dealt by key first: a table in one small file may hold millions of them, and would be one task's.
    """
    fields = StructType([documents.schema[key], *StructType.fromDDL(TOKEN).fields])
    schema = to_arrow_schema(fields)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(t.name) for r in rows], t.type) for t in schema], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in batches:
            for k, body in zip(part.column(0), part.column(1), strict=True):
                blocks, said = Blocks(), body.as_py() or ""
                blocks.run(said.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
                told = {key: k.as_py()}
                held += [{**told, **t} for t in blocks.tokens]
                size += len(said)
                if len(held) >= HELD_TOKENS or size >= HELD_CHARS:
                    if held:
                        yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return documents.select(F.col(key), F.col(text).cast("string")).repartition(key).mapInArrow(run, fields)
