"""Words of batches of texts as numpy arrays, and numbers along an order, shared by the operators on n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean

#: Counts in a row of sums.
SLOT = 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, with A-Z lower-cased, and where each text begins; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return LOWER[data], off - off[0]


def spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, a run of bytes of the table ``is_word`` in one text, and the number of its text."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(data))]  # texts that touch
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


class Vocabulary:
    """The distinct words of a stretch, in byte order: ``ids`` numbers its words; word k is ``text[at[k] : at[k + 1]]``, a space at its end."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, is_word: np.ndarray):
        size = end - start
        own = data[start[0] : end[-1]]
        own = own[is_word[own]]
        text = np.full(len(own) + len(size), 32, np.uint8)
        text[np.arange(len(own)) + np.repeat(np.arange(len(size)), size)] = own
        at = np.concatenate(([0], np.cumsum(size + 1))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(text)]).dictionary_encode()
        order = pc.sort_indices(words.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.ids = rank[words.indices.to_numpy()]
        self.words = words.dictionary.take(order)
        self.at = np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        self.text = np.frombuffer(self.words.buffers()[2], np.uint8)

    def listed(self) -> list[bytes]:
        """The words, without their spaces."""
        text, at = self.text.tobytes(), self.at.tolist()
        return [text[a : b - 1] for a, b in zip(at, at[1:])]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these words one after the other, each with its space."""
        start, size = self.at[ids], self.at[ids + 1] - self.at[ids]
        begin = np.cumsum(size) - size
        return self.text[np.repeat(start - begin, size) + np.arange(int(size.sum()))]


def slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(place, n)``, n above zero, of all rows ``(slot, sums)`` of some slots: the sums of places ``slot * SLOT`` and on, added up."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SLOT)
        for slot, v in zip(b.column(0).to_pylist(), rows):
            sums[slot] = sums.get(slot, 0) + v
    at = np.array(sorted(sums), np.int64)
    n = np.concatenate([sums[k] for k in at.tolist()] or [np.zeros(0, np.int64)])
    place = (at[:, None] * SLOT + np.arange(SLOT)).ravel()
    yield pa.RecordBatch.from_arrays([pa.array(place[n > 0].astype(np.int32)), pa.array(n[n > 0])], ["place", "n"])


def stretches(n: int, most: int, ahead: int) -> Iterator[tuple[int, int, int]]:
    """Words ``[a, b)`` that a stretch of at most ``most`` owns, and the end of what it reads beyond them."""
    for a in range(0, n, most):
        b = min(n, a + most)
        yield a, b, min(n, b + ahead)


def numbered(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3... in the given order, in a table.

    Rows are dealt by ranges of the order and counted where they are, so no
    task sees them all; the driver only adds up one count for each partition.
    Rows that tie in ``order`` may come in any order.
    """
    schema = df.schema
    pid, k = "_pid", "_k"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            more = [pa.array(np.full(n, own, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1, dtype=np.int64))]
            seen += n
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, pid, k])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    placed = scratch.save(dealt.mapInArrow(lean(run), f"{fields}, {pid} int, {k} long"))
    counts = sorted((r[pid], r["n"]) for r in placed.groupBy(pid).agg(F.count(F.lit(1)).alias("n")).collect())  # one for each partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, f"{pid} int, _before long")
    return placed.join(F.broadcast(offsets), pid).withColumn(name, F.col(k) + F.col("_before")).drop(pid, k, "_before")
