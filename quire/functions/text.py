"""Column functions on text: safe Markdown, names, references and measures. All are built of Spark's own functions."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Control characters that become line ends, those that go, and names a file may not have.
LINE_ENDS, CONTROL = "\x0b\x0c\x85", "[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f\\ufffe\\uffff]"
RESERVED = "^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
HIDDEN_MARK = " *(oculta)*"
ACCENTS, PLAIN = "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"
ARROWS, ENDS = ("triangle", "arrow", "stealth"), ("triangle", "arrow", "stealth", "none")
#: Signs of CommonMark's blocks: those that start one whatever follows, bullets, those of thematic breaks, the fences.
OPENERS, BULLETS, BREAKS, FENCES = ("#", ">", "|"), ("-", "+", "*"), "*-_", ("```", "~~~")
#: Lines that one of these, a list's number or the line under a heading may begin.
MAY_START = "^\\s*[-#>|+*_`~=0-9]"
#: Signs of CAD text by their code (fixed values of the format); other codes leave nothing, paragraphs and hard blanks a space.
CAD_SIGNS = {"%%c": "Ø", "%%d": "°", "%%p": "±", "%%%": "%", "\\p": " ", "\\~": " "}
CAD_CODE = r"(%%[CcDdPp%]|\\[A-Za-z][^;]*;|\\[P~]|[{}])"


def sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def clean_control(text: Column) -> Column:
    """Vertical tabs, form feeds and next-line marks become line ends; other control characters go."""
    return sub(F.translate(text, LINE_ENDS, "\n\n\n"), CONTROL, "")


def md_inline(text: Column) -> Column:
    """Text within a line: no active HTML, no entities that would change their meaning."""
    return sub(sub(clean_control(text), "&(?=#?[A-Za-z0-9]+;)", "&amp;"), "<(?=[A-Za-z/!?])", "&lt;")


def _literal_line(line: Column) -> Column:
    """A line with a backslash where its first token would start a block, unless it is indented by four or more.

    A token of up to nine digits and a dot or bracket is a list's number: there the backslash stands before the sign.
    Most lines begin with no sign or digit that could start a block, and stay as they are at one look.
    """
    body = sub(line, "^\\s+", "")
    indent = F.length(line) - F.length(body)
    token, bare = F.regexp_extract(body, "^(\\S*)", 1), sub(body, "\\s+", "")
    only = lambda text, signs: (text != "") & (F.translate(text, signs, "") == "")
    starts = F.substring(body, 1, 1).isin(*OPENERS) | token.isin(*BULLETS)
    for fence in FENCES:
        starts |= F.startswith(body, F.lit(fence))
    starts |= (F.length(bare) >= 3) & only(bare, BREAKS)
    starts |= only(sub(body, "\\s+$", ""), "=")
    digits = F.substring(token, 1, F.length(token) - 1)
    numbered = F.substring(token, -1, 1).isin(".", ")") & (F.length(digits) <= 9) & only(digits, "0123456789")
    at = F.when(indent > 3, 0).when(starts, indent + 1).when(numbered, indent + F.length(token)).otherwise(0)
    return F.when(~F.rlike(line, F.lit(MAY_START)) | (at == 0), line).otherwise(F.concat(F.substring(line, F.lit(1), at - 1), F.lit("\\"), F.substring(line, at, F.length(line))))


def md_text(text: Column) -> Column:
    """Prose as literal Markdown: line beginnings that would start headings, lists, quotes or tables are escaped."""
    lines = F.split(F.regexp_replace(md_inline(text), "\r\n?", "\n"), "\n")
    return F.array_join(F.transform(lines, _literal_line), "\n")


def md_cell(text: Column) -> Column:
    """Text of a table cell: HTML, backslashes, pipes and line ends escaped, in this order."""
    out = clean_control(text)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\"), ("|", "&#124;"), ("\r\n", "<br>"), ("\n", "<br>"), ("\r", "<br>")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def slug(text: Column) -> Column:
    base = sub(F.lower(F.translate(text, ACCENTS, PLAIN)), "[^a-z0-9]+", "-")
    base = sub(base, "^-+|-+$", "")
    return F.when(base == "", F.lit("s")).otherwise(base)


def safe_filename(title: Column) -> Column:
    name = sub(sub(title, '[<>:"/\\\\|?*\\x00-\\x1f]', " "), "\\s+", " ")
    name = F.rtrim(F.substring(F.btrim(name, F.lit(" .")), 1, 150), F.lit(" ."))
    bad = (name == "") | F.rlike(F.upper(F.split_part(name, F.lit("."), F.lit(1))), F.lit(RESERVED))
    return F.when(bad, F.lit("documento")).otherwise(name)


def column_letter(n: Column) -> Column:
    """1 to A, 27 to AA, as far as ZZZ."""
    n = n.cast("int")
    letter = lambda k: F.char(F.lit(65) + F.pmod(k, F.lit(26)))
    tens, hundreds = F.floor((n - 1) / 26), F.floor((F.floor((n - 1) / 26) - 1) / 26)
    return F.concat(F.when(n > 702, letter(hundreds - 1)).otherwise(""), F.when(n > 26, letter(tens - 1)).otherwise(""), letter(n - 1))


def range_ref(row1: Column, col1: Column, row2: Column, col2: Column) -> Column:
    """A1:C4."""
    return F.concat(column_letter(col1), row1.cast("string"), F.lit(":"), column_letter(col2), row2.cast("string"))


def entities(text: Column) -> Column:
    """The five entities that markup needs and the no-break space, ampersands last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def clean_cell(text: Column) -> Column:
    """A cell as one line: breaks become dashes, entities are read, pipes escaped, white space is collapsed; null is empty."""
    read = entities(sub(F.coalesce(text, F.lit("")), "(?i)<br\\s*/?>", " — "))
    return F.trim(sub(F.replace(read, F.lit("|"), F.lit("&#124;")), "(?U)\\s+", " "))


def header_label(header: Column, column: Column) -> Column:
    """A heading with its column's letter: `Code [A]`; the letter alone where there is no other heading."""
    letter = column_letter(column)
    name = F.coalesce(F.nullif(header, F.lit("")), letter)
    return F.when(name == letter, letter).otherwise(F.concat(name, F.lit(" ["), letter, F.lit("]")))


def table_heading(name: Column, otherwise: Column) -> Column:
    """A table's name with spaces for underscores, or another text where it is empty or a workbook's own (Tabla7)."""
    text = F.replace(clean_cell(name), F.lit("_"), F.lit(" "))
    return F.when((text == "") | F.rlike(text, F.lit("(?i)^Tabla\\d+$")), otherwise).otherwise(text)


def hidden_mark(state: Column) -> Column:
    return F.when(state.eqNullSafe("visible"), "").otherwise(HIDDEN_MARK)


def helper_header(text: Column) -> Column:
    """Whether a column heading is a workbook's own: S1, x, Columna3."""
    return F.rlike(F.coalesce(text, F.lit("")), F.lit("(?i)^(?:S\\d*|x|Columna\\d*)$"))


def cad_text(text: Column) -> Column:
    """CAD text without its format codes; signs are read. Codes are met once, from the left: the text is cut before and after each."""
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), CAD_CODE, "\u0001$1\u0002"), "\u0001")
    signs = F.create_map(*[F.lit(x) for pair in CAD_SIGNS.items() for x in pair])

    def read(piece: Column) -> Column:
        code, rest = F.lower(F.split_part(piece, F.lit("\u0002"), F.lit(1))), F.split_part(piece, F.lit("\u0002"), F.lit(2))
        return F.when(F.contains(piece, F.lit("\u0002")), F.concat(F.coalesce(F.try_element_at(signs, code), F.lit("")), rest)).otherwise(piece)

    return F.trim(sub(clean_control(F.array_join(F.transform(pieces, read), "")), "\\s+", " "))


def arc_length(start: Column, end: Column, radius: Column) -> Column:
    """Degrees, counter-clockwise; equal ends are a full circle."""
    turn = F.pmod(end - start, F.lit(360.0))
    return F.radians(F.when(turn == 0, F.lit(360.0)).otherwise(turn)) * radius


def connector(head: Column, tail: Column, start: Column, end: Column) -> Column:
    """A connector's reading: arrows only where both ends are explicit."""
    known, arrow = (lambda x: F.coalesce(x.isin(*ENDS), F.lit(False))), (lambda x: F.coalesce(x.isin(*ARROWS), F.lit(False)))
    joined = lambda sign, a, b: F.concat(a, F.lit(f" {sign} "), b)
    return (
        F.when(~known(head) | ~known(tail), joined("—", start, end))
        .when(arrow(head) & arrow(tail), joined("↔", start, end))
        .when(arrow(head), joined("→", end, start))
        .when(arrow(tail), joined("→", start, end))
        .otherwise(joined("—", start, end))
    )


def query_terms(query: str) -> list[str]:
    """The distinct words of a query in order, in lower case."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def occurrences(text: Column, term: str) -> Column:
    """How often text holds term, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def failure_signature(operation: Column, kind: Column, message: Column) -> Column:
    """16 hex digits that equal failures share: messages are compared in lower case, white space collapsed."""
    normal = F.trim(sub(F.lower(message), "\\s+", " "))
    return F.substring(F.sha2(F.concat_ws("|", operation, kind, normal), 256), 1, 16)


def pipe_columns(line: Column) -> Column:
    """Cells of a table row: pipes that no backslash escapes, less one."""
    return F.regexp_count(line, F.lit(r"(?<!\\)(?:\\\\)*\|")) - 1


def fenced_json(text: Column) -> Column:
    """The body of an answer that is one fenced JSON block, or the text itself."""
    body = F.regexp_extract(text, "(?s)^\\s*```(?:json)?\\s*\\n(.*?)\\n?```\\s*$", 1)
    return F.when(body == "", text).otherwise(body)


def code_fence(text: Column) -> Column:
    """A fence longer than any run of backticks in text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(F.array_max(runs), F.lit(0)) + 1, F.lit(3)))


def ooxml_text(text: Column) -> Column:
    """`_xHHHH_` escapes read in one pass from the left, so that `_x005F_x000D_` is the literal `_x000D_`.

    The text is cut at its escapes; each piece that begins with one gives its character and its rest. A text without any stays as it is.
    """
    escape = "_x([0-9A-Fa-f]{4})_"
    pieces = F.split(F.regexp_replace(text, F.lit(escape), F.lit("\u0001$1\u0002")), "\u0001")
    code = lambda x: F.conv(F.substring(x, 1, 4), 16, 10).cast("int")
    sign = lambda x: F.decode(F.unhex(F.substring(x, 1, 4)), "UTF-16BE")
    read = F.transform(pieces, lambda x: F.when(F.substring(x, 5, 1) == "\u0002", F.concat(F.when(code(x).between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(sign(x)), F.substring(x, 6, 1 << 30))).otherwise(x))
    return F.when(F.contains(text, F.lit("_x")), F.array_join(read, "")).otherwise(text)


def canonical(fields: dict[str, Column]) -> Column:
    """A text of named values that is the same for the same values: names sorted, each value with its length."""
    parts = []
    for name in sorted(fields):
        value = F.coalesce(fields[name].cast("string"), F.lit("\u0000"))
        parts += [F.lit(f"{name}="), F.length(value).cast("string"), F.lit(":"), value, F.lit("\n")]
    return F.concat(*parts)


def valid_scores(score: Column, probabilities: Column) -> Column:
    """Whether a judgement holds together: a score of 0 to 2, three probabilities that sum to 1 and give the score (both within .02)."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(F.transform(probabilities, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    fine = (F.size(probabilities) == 3) & ~F.exists(probabilities, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    return F.coalesce(fine & score.between(0, 2) & (F.abs(total - 1) <= 0.02) & (F.abs(mean - score) <= 0.02), F.lit(False))


@F.pandas_udf(StringType())
def unescaped_twice(text: pd.Series) -> pd.Series:
    """All HTML entities, named and numbered, read twice: Spark has no function for them."""
    return text.map(lambda x: html.unescape(html.unescape(x)), na_action="ignore")


def readable(text: Column) -> Column:
    """Published text as it reads (FN-24): no `<br>`, HTML entities read twice, no Markdown escapes, single white space."""
    plain = unescaped_twice(sub(text, r"(?i)<br\s*/?>", " "))
    return sub(sub(plain, r"\\([\\`*_{}\[\]()#+\-.!|>~])", "$1"), r"(?U)[\s\x1c-\x1f]+", " ")
