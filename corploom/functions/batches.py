"""Arrow batches cut by bytes, so that a Python worker turns few texts into objects at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text, and rows, that are turned into objects at once; a longer text is alone.
AT_ONCE, ROWS_AT_ONCE = 2 << 20, 2048


def cuts(column: pa.Array, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Where pieces of a column begin, and how many rows they have."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        n = max(1, min(rows, int(np.searchsorted(ends, before + most, "right")) - at))
        yield at, n
        at, before = at + n, int(ends[at + n - 1])


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = AT_ONCE, rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column ``text`` of a piece holds few bytes."""
    for b in batches:
        for at, n in cuts(b.column(text), most, rows):
            yield b.slice(at, n)


def by_text(df: DataFrame, columns: list[str], text: str, make: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """Rows of the schema ``ddl`` that ``make`` gives for each row's ``columns``; few bytes of ``text`` are objects at a time."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    place = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, place):
            rows = [r for values in zip(*(c.to_pylist() for c in b.columns)) for r in make(*values)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema.names)

    return df.select(*columns).mapInArrow(run, ddl)
