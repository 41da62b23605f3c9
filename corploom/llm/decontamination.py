"""Benchmark decontamination by pigeonhole edit matching.

Edits are counted in words: lower-cased runs of letters, digits and
underscores, so case, punctuation and white space don't matter.  In scripts
that are written without spaces each character is a word.  An item of m words
may differ from a passage by ``budget(m)`` inserted, deleted or replaced words.
Cut into budget + 1 pieces, at least one piece of it must then occur unchanged;
exact piece hits are found with one hash per word position, and the text around
each hit is verified with Myers' bit-parallel edit distance.

Defined results: null and empty texts match nothing; very long texts are
searched whole; items without a word (null and empty ones too) match nothing,
items of fewer than ``EXACT_BELOW`` words must occur unchanged; items with one
id, or a null one, are searched for one by one and reported under it; an item
found at several places of a document is reported at the first of the best;
repeated rows of documents are each reported; empty tables give an empty
result; other columns are ignored, or kept by ``drop_contaminated``, which
judges every row by its own text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import evict, free_memory, lean, parts, pieces, table

#: Part of an item's words that may be edited; words below which none may; bytes of items that are searched for at once.
ERRORS, EXACT_BELOW, BLOCK_BYTES = 0.2, 8, 16 << 20
#: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han characters: scripts without spaces between words.
_UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, distance int, item_words int, first_word int, n_words int"


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def budget(m: int, errors: float = ERRORS) -> int:
    return int(m * errors) if m >= EXACT_BELOW else 0


def distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edits that turn the item into some run of ``text``, and the end of the first such run.

    Myers' bit-parallel dynamic programme with Python's integers as bit vectors.
    """
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for k, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << k
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask  # the text may start anywhere, so no bit comes in
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """A block of items, ready to search texts."""

    def __init__(self, items: list[tuple[int | None, str]], errors: float = ERRORS):
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int | None, list[int], int]] = []
        pieces: dict[int, list[tuple[int, int, int]]] = {}  # length -> (hash, item, offset)
        seen = set()
        for item_id, text in items:
            ws = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            if not ws or (item_id, tuple(ws)) in seen:
                continue
            seen.add((item_id, tuple(ws)))
            k = budget(len(ws), errors)
            cuts = [len(ws) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                h = self.hashes(np.array(ws[a:b], np.uint64), b - a)[0]
                pieces.setdefault(b - a, []).append((int(h), len(self.items), a))
            self.items.append((item_id, ws, k))
        self.pieces = {}
        for n, rows in sorted(pieces.items()):
            rows.sort()
            self.pieces[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of n ids."""
        with np.errstate(over="ignore"):
            h = ids[: len(ids) - n + 1].copy()
            for k in range(1, n):
                h = h * _BASE + ids[k : len(ids) - n + 1 + k]
            return (h ^ (h >> np.uint64(31))) * _BASE

    def search(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, distance, item words, first word, words) of each item found, at its best place."""
        ws = words(text)
        if not self.items or not ws:
            return []
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in ws), np.uint64, len(ws))
        if not ids.any():
            return []
        starts: dict[int, set[int]] = {}
        for n, (known, item, offset) in self.pieces.items():
            if len(ids) < n:
                continue
            h = self.hashes(ids, n)
            lo = np.searchsorted(known, h)
            near = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == h)
            for at in near.tolist():
                if not ids[at : at + n].all():
                    continue
                j = int(lo[at])
                while j < len(known) and known[j] == h[at]:
                    starts.setdefault(int(item[j]), set()).add(at - int(offset[j]))
                    j += 1
        out = []
        listed = ids.tolist() if starts else []
        for i, begins in starts.items():
            item_id, want, k = self.items[i]
            m = len(want)
            best, lo, hi = (k + 1, 0, 0), None, 0
            runs: list[tuple[int, int]] = []
            for s in sorted(begins):  # windows that overlap are one
                a, b = max(0, s - k), min(len(listed), s + m + 2 * k)
                if runs and a <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
                else:
                    runs.append((a, b))
            for a, b in runs:
                d, end = distance(want, listed[a:b])
                if d < best[0]:
                    # the same programme from the end back to the start of the best run
                    _, size = distance(want[::-1], listed[a : a + end][::-1])
                    best = (d, a + end - size, size)
            if best[0] <= k:
                out.append((item_id, best[0], m, best[1], best[2]))
        return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, so that what is sent to the executors never grows with the table."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["id"], r["text"]) for r in own.orderBy("id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: float = ERRORS, most: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item whose passage it holds: ``SCHEMA``."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for block in blocks(benchmark, most=most):
        sent = spark.sparkContext.broadcast(Matcher(block, errors))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = sent.value
            for b in pieces(batches, 1):
                got = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in matcher.search(t)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)], names)

        out = out.unionByName(src.mapInArrow(lean(run), SCHEMA))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", errors: float = ERRORS, most: int = BLOCK_BYTES) -> DataFrame:
    """Rows whose text holds no benchmark passage, all columns kept; nothing is shuffled."""
    spark = docs.sparkSession

    def clean(sent: Broadcast) -> Column:
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            evict()
            matcher = sent.value
            for whole in columns:
                yield pa.array([not matcher.search(t) for c in parts(whole) for t in c.to_pylist()], pa.bool_())
            free_memory()

        return F.arrow_udf(run, "boolean")(F.col(text_col).cast("string"))

    for block in blocks(benchmark, most=most):
        docs = docs.where(clean(spark.sparkContext.broadcast(Matcher(block, errors))))
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
