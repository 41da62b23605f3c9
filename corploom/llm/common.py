"""What the operators share: scratch tables, the tables' place, batches of bounded size and names that clash with none."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, free_shuffles, release, scope, shared_dir

__all__ = ["Scratch", "evict", "fresh", "free_memory", "free_shuffles", "lean", "parts", "pieces", "release", "resident", "scope", "shared_dir", "table", "text_key"]

#: Bytes of text, and rows, that a Python worker turns into objects at once; a longer text is alone.
AT_ONCE, ROWS_AT_ONCE = 2 << 20, 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that ``df`` has no column of, whatever the case: underscores are put before it until it is free."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text; null and empty texts alike."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _cuts(column: pa.Array, most: int, rows: int) -> Iterator[tuple[int, int]]:
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(size)))
    at, n = 0, len(size)
    while at < n:
        end = int(np.searchsorted(total, total[at] + most, "right")) - 1
        end = min(n, at + rows, max(at + 1, end))
        yield at, end - at
        at = end


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = AT_ONCE, rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column ``text`` of a piece holds few bytes."""
    for b in batches:
        for at, n in _cuts(b.column(text), most, rows):
            yield b.slice(at, n)


def parts(column: pa.Array, most: int = AT_ONCE, rows: int = ROWS_AT_ONCE) -> Iterator[pa.Array]:
    """The same for one column of texts."""
    for at, n in _cuts(column, most, rows):
        yield column.slice(at, n)


_RESIDENT: dict[str, tuple[object, object]] = {}


def evict(but: str | None = None) -> None:
    """Drop what tasks of other operators left in this worker process."""
    for owner in [n for n in _RESIDENT if n != but]:
        del _RESIDENT[owner]


def resident(owner: str, key: object, make: Callable[[], object]):
    """An object that stays in the worker process for the operator's next task of this key, until a task of another operator begins."""
    if owner not in _RESIDENT or _RESIDENT[owner][0] != key:
        _RESIDENT[owner] = key, make()
    return _RESIDENT[owner][1]


def free_memory() -> None:
    """Give back what the last task left: a worker process serves many tasks, and memory that it keeps is lost to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow: at its begin what other operators left goes, at its end memory is given back; ``keeps`` names its own resident."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evict(keeps)
        try:
            yield from run(batches)
        finally:
            free_memory()

    return task
