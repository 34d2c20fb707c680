"""The reading view of workbooks on small sheets."""

from pyspark.sql import functions as F

from quire.operators import structure as X

CELLS, TABLES = "sheet string, row long, col long, value string", "sheet string, name string, min_row long, min_col long, max_row long, max_col long"
MERGES, SHEETS = "sheet string, min_row long, min_col long, max_row long, max_col long", "sheet string, name string, state string"


def built(spark, cells, tables=(), merges=(), sheets=(("a", "A", "visible"),)):
    given = spark.createDataFrame(list(cells), CELLS), spark.createDataFrame(list(tables), TABLES), spark.createDataFrame(list(merges), MERGES), spark.createDataFrame(list(sheets), SHEETS)
    return X.structure(*given), given


def test_a_wide_table_without_words_or_labels_is_cut_nine_by_nine_and_keeps_its_first_column(spark):
    cells = [("a", 1, c, f"h{c}") for c in range(1, 21)] + [("a", 2, c, str(c)) for c in range(1, 21)]
    blocks, given = built(spark, cells, [("a", "Tabla3", 1, 1, 3, 20)])
    rows = blocks.orderBy("nth", "part").collect()
    assert [(r.kind, r.part, r.title) for r in rows] == [("table_group", 0, "A"), ("table", 1, "h1 → h9"), ("table", 2, "h10 → h18"), ("table", 3, "h19 → h20")]
    assert [r.columns for r in rows[1:]] == [list(range(1, 10)), [1, *range(10, 19)], [1, 19, 20]] and [r.repeated for r in rows[1:]] == [[], [1], [1]]
    filled = given[0].withColumn("said", F.col("value"))
    assert X.uncovered_columns(X.wide_tables(X._tables(given[1]), filled, given[2])).count() == 0


def test_a_table_of_the_workbook_s_own_columns_only_is_one_group(spark):
    blocks, _ = built(spark, [("a", 1, c, f"S{c}") for c in range(1, 11)], [("a", "t", 1, 1, 2, 10)])
    part = blocks.filter("part = 1").first()
    assert (part.title, part.evidence, part.columns) == ("Campos técnicos del libro", "encabezados auxiliares", list(range(1, 11)))


def test_labels_of_several_rows_may_share_columns_and_a_label_without_text_is_none(spark):
    cells = [("a", 4, c, f"h{c}") for c in range(1, 12)] + [("a", 1, 2, "upper"), ("a", 3, 3, "lower"), ("a", 3, 8, " ")]
    blocks, _ = built(spark, cells, [("a", "t", 4, 1, 5, 11)], [("a", 1, 2, 1, 5), ("a", 3, 3, 3, 4), ("a", 3, 8, 3, 9)])
    assert [(r.title, r.evidence, r.columns) for r in blocks.filter("part > 0").orderBy("part").collect()] == [
        ("h1 → h11", "encabezados de la tabla", [1, 6, 7, 8, 9, 10, 11]), ("upper", "B1:E1", [1, 2, 3, 4, 5]), ("lower", "C3:D3", [1, 3, 4]),
    ]
    assert blocks.filter("kind = 'notes'").count() == 0


def test_sheets_without_tables_and_without_cells(spark):
    cells = [("a", 1, 1, "n|<br>x"), ("a", 3, 2, "p"), ("a", 4, 2, "q"), ("a", 3, 5, "r"), ("a", 3, 6, "s"), ("a", 9, 9, "  ")]
    blocks, given = built(spark, cells, sheets=[("a", "A", "visible"), ("b", "B", "veryHidden")])
    assert [(r.kind, r.title, r["items"]) for r in blocks.orderBy("nth").collect()] == [
        ("notes", "Notas y controles del archivo", ["`A1:A1` — n&#124; — x"]), ("list", "Lista B3:B4", ["p", "q"]), ("table", "Bloque E3:F3", None),
    ]
    told = {r.sheet: (r.hidden, r.markdown) for r in X.sheet_sections(blocks, given[0], given[3]).collect()}
    assert told["b"] == (True, "## Hoja: B *(oculta)*\nfilas 0 · columnas con dato 0 · 0 tablas nativas\n\n> Rango usado `` · 0 celdas con dato.\n\n*(hoja sin celdas con datos)*\n")
    assert told["a"][1].endswith("### Bloque E3:F3\n\n*Fuente: `E3:F3` · confianza media.*\n\n| E | F |\n| --- | --- |\n| r | s |\n")
    assert built(spark, [])[0].count() == 0
