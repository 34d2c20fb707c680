"""Listings for spreadsheets: semicolons between fields, every field that needs it quoted, lines kept inside fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: How a listing is written.
FORM = {"sep": ";", "quote": '"', "escape": '"', "encoding": "UTF-8", "header": "true", "emptyValue": "", "lineSep": "\n"}


def write_listing(rows: DataFrame, place: str) -> None:
    """Rows as `;` files in a new folder, one a task; nulls and empty texts are both empty fields."""
    rows.write.options(**FORM, quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(place)


def read_listing(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """A folder of listings as rows; a file is one task, as its fields may hold line ends."""
    return spark.read.options(**{k: v for k, v in FORM.items() if k != "lineSep"}, multiLine="true", mode="FAILFAST").schema(schema).csv(place)
