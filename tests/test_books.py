"""Books and CSV files that are odd."""

import pytest
from test_office import members, zipped

from quire.sources import books


@pytest.mark.parametrize(
    ("text", "sign"),
    [("a,b\n1,2", ","), ("a;b,c\n1;2\n3;4", ";"), ("a\tb\n", "\t"), ("one\ntwo", ","), ("", ","), ('"a;b",c\n"d;e",f', ","), ("a|b|c\n1|2|3", "|"), ("x,y;z\nx;z\nx;z", ";")],
)
def test_separators(text, sign):
    assert books.separator_of(text) == sign


def test_csv_files_that_are_not_read_are_told(spark):
    given = [("a", b"\xff\xfe"), ("b", None), ("c", b""), ("d", '﻿x;"y\n""z"""\n\n;\n'.encode()), ("e", b'a,"' + b"x" * 200_000 + b'"')]
    found = sorted(books.csv_rows(spark.createDataFrame(given, "path string, content binary")).collect(), key=lambda r: (r.path, r.row_no or 0))
    assert [(r.path, r.separator, r.row_no, r["cells"], r.fault) for r in found] == [
        ("a", None, None, None, "not utf-8"), ("b", None, None, None, "no content"), ("d", ";", 1, ["x", 'y\n"z"'], None), ("d", ";", 2, ["", ""], None), ("e", None, None, None, "damaged"),
    ]


def test_a_spine_may_repeat_and_lack_chapters(spark):
    package = '<package><manifest><item id="a" href="a.xhtml#x"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="a"/><itemref idref="zz"/></spine></package>'
    book = zipped(**{"META-INF/container.xml": '<container><rootfile full-path="p.opf"/></container>', "p.opf": package, "a.xhtml": "<p>A</p>"})
    from quire.sources import office

    found = office.members(spark.createDataFrame([("f", book)], "path string, content binary"))
    assert [(r.position, r.member, r.html) for r in books.book_chapters(found).orderBy("position").collect()] == [(1, "b.xhtml", None), (2, "a.xhtml", "<p>A</p>"), (3, "a.xhtml", "<p>A</p>")]
    assert [(r.position, r.block_no, r.text) for r in books.book_blocks(found).orderBy("block_no").collect()] == [(2, 1, "A"), (3, 2, "A")]
    assert books.book_blocks(members(spark, b"no book")).count() == 0
