"""Arrow batches in and out of tasks: columns added to rows, without holding more than a slice of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about limit bytes of column each."""
    sizes = np.asarray(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0))
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


def with_columns(
    df: DataFrame, fields: str, make: Callable[[], Callable[[pa.RecordBatch], Sequence[pa.Array]]], by: str, drop: Iterable[str] = (), done: Callable[[], None] = lambda: None
) -> DataFrame:
    """df and the columns of fields (a DDL string), which make()(slice) gives for each slice of about SLICE_BYTES of the column by.

    Columns of drop go; columns of df that clash with fields, whatever their case, are replaced. make() runs once a task, done() at its end.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = StructType.fromDDL(fields)
    gone = {c.lower() for c in (*drop, *added.names)}
    schema = StructType([f for f in df.schema.fields if f.name.lower() not in gone] + added.fields)
    stay = [f.name for f in df.schema.fields if f.name.lower() not in gone]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, names, types = make(), [*stay, *added.names], to_arrow_schema(added)
        for batch in batches:
            for part in slices(batch, by):
                new = [x.cast(t.type) if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(work(part), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), *new], names=names)
        done()

    return df.mapInArrow(run, schema)


def texts(part: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings, '' for null."""
    return [x or "" for x in part.column(column).to_pylist()]


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and the places where its values begin and the last one ends; null is empty."""
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    _, places, data = array.buffers()
    ends = np.frombuffer(places, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])
