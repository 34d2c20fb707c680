"""Parts of Office archives, each read once as a stream: flat rows of what Word bodies and slides hold.

Elements and attributes are told by their local names, so that any prefix will do. A reader holds what is open
(paragraph, cell, table, shape) and hands on a row when it closes; joins, order and merges are Spark's, on the rows.
A part whose XML is damaged is one row of kind `damaged`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a document that are not its text, and how a formula's element is written on one line.
UNSAID = frozenset(("rPr", "tabs", "instrText", "delText", "del", "moveFrom", "Fallback"))
LINEAR = {
    "f": "({num})/({den})",
    "sSup": "{e}^({sup})",
    "sSub": "{e}_({sub})",
    "sSubSup": "{e}_({sub})^({sup})",
    "nary": "{chr}_({sub})^({sup}) {e}",
}
SIGNS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
#: Symbol fonts have their signs in this private block.
PRIVATE = 0xF000
NOTES = ("footnote", "endnote", "comment")
MARGINS = {"hdr": "header", "ftr": "footer"}


def linear(element: ElementTree.Element) -> str:
    """A formula's element on one line."""
    parts, settings = {}, {}
    for child in element:
        if child.tag.endswith("Pr"):
            settings |= {s.tag: s.get("val", "") for s in child}
        else:
            parts.setdefault(child.tag, []).append(linear(child))
    joined = {name: "".join(texts) for name, texts in parts.items()}
    if element.tag == "t":
        return element.text or ""
    if element.tag == "d":
        return (settings.get("begChr") or "(") + ",".join(parts.get("e", [])) + (settings.get("endChr") or ")")
    if element.tag == "rad":
        root = f"root[{joined['deg']}]" if joined.get("deg") else "√"
        return f"{root}({joined.get('e', '')})"
    if element.tag in LINEAR:
        empty = dict.fromkeys(("num", "den", "e", "sub", "sup"), "")
        return LINEAR[element.tag].format(**empty | {"chr": settings.get("chr") or "∫"} | joined)
    return "".join(linear(child) for child in element if not child.tag.endswith("Pr"))


def number(text: str | None) -> int | None:
    try:
        return int(text or "")
    except ValueError:
        return None


class Part:
    """Goes over a part: opened(name, attributes) and closed(name) by local name, said(text); rows are dicts.

    kinds: the kinds of rows that are kept, every kind without it. heeds: the elements that opened and closed are told of,
    every one without it.
    """

    fields = "kind string"
    kinds: frozenset[str] | None = None
    heeds: frozenset[str] | None = None
    #: Names as written to local ones, "" for those that are not heeded, and how many are kept.
    names: dict[str, str] = {}
    MOST_NAMES = 10_000

    def __init_subclass__(cls) -> None:
        cls.names = {}

    @classmethod
    def only(cls, *kinds: str) -> type[Part]:
        """A reader that keeps rows of these kinds: a part's rows are held to its end, as a damaged part has no others."""
        return type(cls.__name__, (cls,), {"kinds": frozenset(kinds)})

    def __init__(self):
        self.rows, self.hidden = [], 0

    def read(self, content: bytes) -> list[dict]:
        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self._start, self._end, self._text
        parser.EntityDeclHandler = self._entity
        try:
            parser.Parse(content, True)
        except (expat.ExpatError, ValueError):
            return [{"kind": "damaged"}]
        return self.rows

    def keep(self, row: dict) -> None:
        if self.kinds is None or row["kind"] in self.kinds:
            self.rows.append(row)

    def _entity(self, *_: object) -> None:
        raise ValueError("a part declares no entities")

    def _local(self, name: str) -> str:
        local = name.rpartition(":")[2]
        if len(self.names) >= self.MOST_NAMES:
            self.names.clear()
        self.names[name] = told = local if self.heeds is None or local in self.heeds or local in UNSAID else ""
        return told

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        if self.hidden:
            self.hidden += 1
            return
        local = self.names.get(name)
        name = self._local(name) if local is None else local
        if not name:
            return
        if name in UNSAID:
            self.hidden += 1
            return
        if not attributes or ":" not in "".join(attributes):
            self.opened(name, attributes)
            return
        told = {}
        for key, value in attributes.items():  # *id: an attribute with a prefix, where another has none
            prefix, _, local = key.rpartition(":")
            told["*" + local if prefix else local] = value
        self.opened(name, {k[1:]: v for k, v in told.items() if k[0] == "*"} | told)

    def _end(self, name: str) -> None:
        if self.hidden:
            self.hidden -= 1
            return
        local = self.names.get(name)
        name = self._local(name) if local is None else local
        if name:
            self.closed(name)

    def _text(self, text: str) -> None:
        if not self.hidden:
            self.said(text)

    def opened(self, name: str, given: dict[str, str]) -> None:
        raise NotImplementedError

    def closed(self, name: str) -> None:
        raise NotImplementedError

    def said(self, text: str) -> None:
        raise NotImplementedError


class WordPart(Part):
    """Rows of kind paragraph, cell, link, formula, footnote, endnote, comment, header, footer.

    nth: paragraphs and links by their beginning, formulas and notes in order. label: the table (2, or 2.1 for the
    first within a cell of table 2) that a paragraph or cell stands in. A cell's text is its own paragraphs' that say
    something, with `[tabla anidada 2.1]` where a table stands in it.
    """

    fields = (
        "kind string, nth int, text string, style string, num int, ilvl int, label string, row_no int, cell_no int, col int, span int, goes_on boolean, "
        "id int, type string, author string, rel string, anchor string"
    )

    def __init__(self):
        super().__init__()
        self.paragraphs, self.tables, self.links, self.said_in_run = [], [], [], False
        self.n = dict.fromkeys(("p", "tbl", "link", "formula", "note"), 0)
        self.math, self.depth, self.note, self.told = None, 0, None, []

    def _next(self, what: str) -> int:
        self.n[what] += 1
        return self.n[what]

    def _place(self) -> dict:
        t = self.tables[-1] if self.tables else None
        return {"label": t["label"], "row_no": t["row"], "cell_no": t["cell"]} if t else {}

    def write(self, text: str) -> None:
        if self.paragraphs:
            self.paragraphs[-1]["out"].append(text)
            if self.links:
                self.links[-1]["out"].append(text)

    def opened(self, name: str, given: dict[str, str]) -> None:
        value, table = given.get("val"), self.tables[-1] if self.tables else None
        if self.math is not None or name == "oMath":
            self.math, self.depth = self.math or ElementTree.TreeBuilder(), self.depth + 1
            self.math.start(name, given)
        elif name == "p":
            self.paragraphs.append({"nth": self._next("p"), "out": [], "depth": len(self.tables), **self._place()})
        elif name in ("pStyle", "numId", "ilvl") and self.paragraphs:
            self.paragraphs[-1][{"pStyle": "style", "numId": "num"}.get(name, name)] = value if name == "pStyle" else number(value)
        elif name == "tbl":
            label = str(self._next("tbl")) if table is None else f"{table['label']}.{table['inner'] + 1}"
            if table is not None:
                table["inner"] += 1
                table["pieces"].append(f"[tabla anidada {label}]")
            self.tables.append({"label": label, "row": 0, "cell": 0, "col": 1, "inner": 0, "pieces": [], "span": 1, "goes_on": False})
        elif name == "tr" and table is not None:
            table |= {"row": table["row"] + 1, "cell": 0, "col": 1}
        elif name == "gridBefore" and table is not None:
            table["col"] += max(0, number(value) or 0)
        elif name == "tc" and table is not None:
            table |= {"cell": table["cell"] + 1, "span": 1, "goes_on": False, "pieces": []}
        elif name == "gridSpan" and table is not None:
            table["span"] = max(1, number(value) or 1)
        elif name == "vMerge" and table is not None:
            table["goes_on"] = value != "restart"
        elif name == "t":
            self.said_in_run = True
        elif name in SIGNS:
            self.write(SIGNS[name])
        elif name == "sym":
            code = int(given.get("char", ""), 16) if set(given.get("char", "-").lower()) <= set("0123456789abcdef") and given.get("char") else 0
            self.write(chr(code - PRIVATE if code >= PRIVATE else code) if code else "")
        elif name == "hyperlink":
            self.links.append({"nth": self._next("link"), "out": [], "rel": given.get("*id"), "anchor": given.get("anchor")})
        elif name in NOTES or name in MARGINS:
            self.note, self.told = {"kind": MARGINS.get(name, name), "id": number(given.get("id")), "type": given.get("type"), "author": given.get("author")}, []

    def closed(self, name: str) -> None:
        if self.math is not None:
            self.math.end(name)
            self.depth -= 1
            if not self.depth:
                self.keep({"kind": "formula", "nth": self._next("formula"), "text": linear(self.math.close())})
                self.math = None
        elif name == "p" and self.paragraphs:
            p = self.paragraphs.pop()
            text = "".join(p.pop("out"))
            if self.tables and p.pop("depth") == len(self.tables):
                self.tables[-1]["pieces"].append(text)
            if self.note:
                self.told.append(text)
            self.keep({**p, "kind": "paragraph", "text": text})
        elif name == "tc" and self.tables:
            t = self.tables[-1]
            text = "\n".join(x for x in t["pieces"] if x.strip())
            self.keep({"kind": "cell", "text": text, "label": t["label"], "row_no": t["row"], "cell_no": t["cell"], "col": t["col"], "span": t["span"], "goes_on": t["goes_on"]})
            t["col"] += t["span"]
        elif name == "tbl" and self.tables:
            self.tables.pop()
        elif name == "t":
            self.said_in_run = False
        elif name == "hyperlink" and self.links:
            link = self.links.pop()
            self.keep({**link, "kind": "link", "text": "".join(link["out"])})
        elif self.note and name in (*NOTES, *MARGINS):
            self.keep({**self.note, "nth": self._next("note"), "text": "\n".join(self.told)})
            self.note = None

    def said(self, text: str) -> None:
        if self.math is not None:
            self.math.data(text)
        elif self.said_in_run:
            self.write(text)


class SlidePart(Part):
    """Rows of kind shape (with a text body), connector and cell, nth in the order of their beginning.

    groups: the group shapes around it, the outermost first. hidden: the whole slide is. ph: a placeholder's type.
    """

    fields = (
        "kind string, nth int, shape_id bigint, groups array<bigint>, text string, hidden boolean, ph string, src bigint, dst bigint, head string, tail string, "
        "table_no int, row_no int, col int"
    )
    SHAPES = {"sp": "shape", "cxnSp": "connector", "graphicFrame": "frame", "pic": "picture", "grpSp": "group"}
    heeds = frozenset((*SHAPES, "sld", "notes", "cNvPr", "ph", "stCxn", "endCxn", "headEnd", "tailEnd", "tbl", "tr", "tc", "txBody", "p", "br", "t"))

    def __init__(self):
        super().__init__()
        self.open, self.n, self.away, self.tables, self.writing = [], 0, False, 0, False
        self.lines, self.cell, self.line = [], None, None

    def opened(self, name: str, given: dict[str, str]) -> None:
        if name == "t":
            self.writing = True
            return
        if name == "p":
            self.line = []
            return
        shape = self.open[-1] if self.open else None
        if name == "tc" and self.cell:
            self.cell[2] += 1
            self.lines = []
        elif name == "txBody" and shape is not None and not self.cell:
            shape["lines"] = self.lines = []
        elif name in ("sld", "notes"):
            self.away = given.get("show") in ("0", "false")
        elif name in self.SHAPES:
            self.n += 1
            self.open.append({"kind": self.SHAPES[name], "nth": self.n, "lines": None})
        elif name == "cNvPr" and shape is not None:
            shape.setdefault("shape_id", number(given.get("id")))
        elif name == "ph" and shape is not None:
            shape["ph"] = given.get("type")
        elif name in ("stCxn", "endCxn") and shape is not None:
            shape["src" if name == "stCxn" else "dst"] = number(given.get("id"))
        elif name in ("headEnd", "tailEnd") and shape is not None:
            shape[name[:4]] = given.get("type", "none")
        elif name == "tbl":
            self.tables, self.cell = self.tables + 1, [self.tables + 1, 0, 0]
        elif name == "tr" and self.cell:
            self.cell[1:] = [self.cell[1] + 1, 0]
        elif name == "br" and self.line is not None:
            self.line.append("\n")

    def closed(self, name: str) -> None:
        if name == "t":
            self.writing = False
        elif name == "p":
            if self.line is not None:
                self.lines.append("".join(self.line))
                self.line = None
        elif name in self.SHAPES and self.open:
            shape = self.open.pop()
            lines, groups = shape.pop("lines"), [s.get("shape_id") for s in self.open if s["kind"] == "group"]
            if shape["kind"] == "connector" or shape["kind"] == "shape":
                self.keep({**shape, "groups": groups, "text": "\n".join(lines or []), "hidden": self.away})
        elif name == "tc" and self.cell:
            frame = self.open[-1] if self.open else {"nth": 0}
            self.keep({"kind": "cell", "nth": frame["nth"], "shape_id": frame.get("shape_id"), "text": "\n".join(self.lines), "hidden": self.away, "table_no": self.cell[0], "row_no": self.cell[1], "col": self.cell[2]})
        elif name == "tbl":
            self.cell = None

    def said(self, text: str) -> None:
        if self.writing and self.line is not None:
            self.line.append(text)


class EdgePart(SlidePart.only("shape", "connector")):
    """Rows of kind edge: a slide's connectors, with what the shapes at their ends say (first lines, 60 characters).

    Ends are shapes of the same slide. An end that several shapes of one number have gives a row each.
    """

    fields = "kind string, shape_id bigint, src bigint, dst bigint, head string, tail string, src_text string, dst_text string"

    def read(self, content: bytes) -> Iterator[dict]:
        rows, texts = super().read(content), {}
        for row in rows:
            if row["kind"] == "shape" and row.get("shape_id") is not None:
                texts.setdefault(row["shape_id"], []).append(row["text"].partition("\n")[0][:60])
        for row in rows:
            if row["kind"] == "connector":
                for src in texts.get(row.get("src"), [None]):
                    for dst in texts.get(row.get("dst"), [None]):
                        yield {**row, "kind": "edge", "src_text": src, "dst_text": dst}


class RelationsPart(Part):
    """Rows of kind relation: a part's relations (rel) and their targets."""

    fields = "kind string, rel string, target string"
    heeds = frozenset(("Relationship",))

    def opened(self, name: str, given: dict[str, str]) -> None:
        self.rows.append({"kind": "relation", "rel": given.get("Id"), "target": given.get("Target")})

    def closed(self, name: str) -> None:
        pass

    def said(self, text: str) -> None:
        pass


class DeckPart(Part):
    """Rows of kind slide: the presentation's slides in their order, by relation."""

    fields = "kind string, nth int, rel string"
    heeds = frozenset(("sldId",))

    def opened(self, name: str, given: dict[str, str]) -> None:
        if name == "sldId":
            self.rows.append({"kind": "slide", "nth": len(self.rows) + 1, "rel": given.get("*id")})

    def closed(self, name: str) -> None:
        pass

    def said(self, text: str) -> None:
        pass


class SheetPart(Part):
    """Rows of kind cell, merge and table, of a sheet: a cell's type, value as written, own text, formula and shared formula.

    A sheet of over MOST_CELLS cells gives one row of kind `too large` and nothing else. rel: a declared table's relation.
    """

    MOST_CELLS = 1_000_000
    fields = "kind string, cell string, type string, value string, text string, formula string, shared int, ref string, rel string"

    def __init__(self):
        super().__init__()
        self.cell, self.into, self.n = None, None, 0

    def read(self, content: bytes) -> list[dict]:
        rows = super().read(content)
        return [{"kind": "too large", "value": str(self.n)}] if self.n > self.MOST_CELLS else rows

    def opened(self, name: str, given: dict[str, str]) -> None:
        if name == "c":
            self.n += 1
            if self.n > self.MOST_CELLS:
                self.rows.clear()
            self.cell = {"kind": "cell", "cell": given.get("r"), "type": given.get("t", "n")}
        elif name == "mergeCell":
            self.rows.append({"kind": "merge", "ref": given.get("ref")})
        elif name == "tablePart":
            self.rows.append({"kind": "table", "rel": given.get("*id")})
        elif self.cell is not None and name in ("v", "f", "t"):
            self.into = {"v": "value", "f": "formula", "t": "text"}[name]
            self.cell.setdefault(self.into, "")
            if name == "f" and given.get("t") == "shared":
                self.cell |= {"shared": number(given.get("si")), "ref": given.get("ref")}

    def closed(self, name: str) -> None:
        if name == "c" and self.cell is not None:
            if self.n <= self.MOST_CELLS:
                self.rows.append(self.cell)
            self.cell = None
        elif name in ("v", "f", "t"):
            self.into = None

    def said(self, text: str) -> None:
        if self.into and self.cell is not None:
            self.cell[self.into] += text


class StringsPart(Part):
    """Rows of kind string: a workbook's shared strings by their number from 0, without their phonetic readings."""

    fields = "kind string, nth int, text string"

    def __init__(self):
        super().__init__()
        self.own, self.away, self.writing = None, 0, False

    def opened(self, name: str, given: dict[str, str]) -> None:
        if name == "si":
            self.own = []
        self.away += name == "rPh"
        self.writing = name == "t" and not self.away

    def closed(self, name: str) -> None:
        if name == "si" and self.own is not None:
            self.rows.append({"kind": "string", "nth": len(self.rows), "text": "".join(self.own)})
            self.own = None
        self.away -= name == "rPh"
        self.writing = False

    def said(self, text: str) -> None:
        if self.writing and self.own is not None:
            self.own.append(text)


class TablePart(Part):
    """A row of kind declared: a table's name and range."""

    fields = "kind string, name string, ref string"

    def opened(self, name: str, given: dict[str, str]) -> None:
        if name == "table":
            self.rows.append({"kind": "declared", "name": given.get("displayName") or given.get("name"), "ref": given.get("ref")})

    def closed(self, name: str) -> None:
        pass

    def said(self, text: str) -> None:
        pass


def rows_of(found: DataFrame, member: str, reader: type[Part]) -> DataFrame:
    """path, member and the reader's rows of the members of this name (a pattern); found: path, member, content.

    Members travel as an RDD, whose batches are bounded by bytes; Arrow's would hold ten thousand members or 64 MB.
    """
    fields = StructType.fromDDL("path string, member string, " + reader.fields)
    own = fields.names[2:]

    def read(parts: Iterable[tuple[str, str, bytes]]) -> Iterator[tuple]:
        for path, name, content in parts:
            for row in reader().read(content):
                yield path, name, *[row.get(k) for k in own]

    wanted = found.filter(F.rlike("member", F.lit(member)) & F.col("content").isNotNull()).select("path", "member", "content")
    return found.sparkSession.createDataFrame(wanted.rdd.mapPartitions(read), fields, verifySchema=False)
