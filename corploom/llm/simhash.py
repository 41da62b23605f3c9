"""Near-duplicate detection on 64-bit SimHash fingerprints.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or
and bit counts.  A tile holds fingerprints of one cell: one population count of
the upper half and one of the lower.  Tile pairs whose counts differ by more
than the radius, the halves' differences added up, are never formed.

Defined results: null and empty texts have fingerprint zero and link like any
other; a text of fewer words than a shingle is one shingle; very long texts are
hashed whole and summed up in parts; repeated rows each get a row; a null
doc_id gets a row and never names a component unless all members are null; an
empty table gives an empty result; other columns are ignored, or kept by
``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, lean, pieces, table, text_key
from .components import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42


def shingle_hashes(text: bytes, width: int = 3) -> list[int]:
    """XXH64 of each run of ``width`` words, joined by one space, in order."""
    import xxhash

    words = text.translate(LOWER).split()  # ASCII white space only, as bytes.split does
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return [h(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())]


def fingerprints(texts: list[bytes | None], width: int = 3, at_once: int = 20_000) -> np.ndarray:
    """Signed 64-bit fingerprints; bit set where over half the hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    held: list[list[int]] = []
    ids: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if ids:
            n = np.array([len(h) for h in held])
            flat = np.fromiter((x for h in held for x in h), np.uint64, size).astype(">u8")
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1)
            total = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(n)[:-1])), axis=0, dtype=np.int64)
            packed = np.packbits(2 * total > n[:, None], axis=1)
            out[ids] = packed.view(">u8").ravel().astype(np.uint64)
        held.clear(), ids.clear()
        size = 0

    for i, t in enumerate(texts):
        h = shingle_hashes(t or b"", width)
        if len(h) > at_once:  # one very long text: sum it in parts
            total = np.zeros(64, np.int64)
            for k in range(0, len(h), at_once):
                part = np.array(h[k : k + at_once], np.uint64).astype(">u8")
                total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * total > len(h)).view(">u8")[0]
        elif h:
            held.append(h), ids.append(i)
            size += len(h)
            if size >= at_once:
                flush()
    flush()
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, h, fp)`` for every row; ``h`` tells apart the texts of one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            fp = fingerprints(b.column(2).cast(pa.binary()).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "h", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), "doc_id long, h long, fp long")


class _Forest:
    """Union-find that keeps the edges which joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        a, b = root[i], root[j]
        new = a != b
        if not new.any():
            return
        i, j = i[new], j[new]
        _, at = np.unique(np.stack([a[new], b[new]]), axis=1, return_index=True)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(i[at].tolist(), j[at].tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                self.edges.append((x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def linked(a: np.ndarray, b: np.ndarray, radius: int, block: int = 64, width: int = 8192) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links between fingerprints of a and b."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    forest = _Forest(len(values))
    for k in range(0, len(a), block):
        for m in range(0, len(b), width):
            near = np.bitwise_count(a[k : k + block, None] ^ b[None, m : m + width]) <= radius
            i, j = np.nonzero(near)
            if len(i):
                forest.add(ia[k + i], ib[m + j])
    return [(int(values[x].view(np.int64)), int(values[y].view(np.int64))) for x, y in forest.edges]


def links(fps: DataFrame, radius: int = 3, tile_rows: int = 65_536) -> DataFrame:
    """Edges ``(a, b)`` that connect what the links of distinct ``fps(fp)`` connect.

    A tile is one array of about ``tile_rows`` fingerprints (512 KB) at most.
    Each tile names the pairs that it is part of by itself, from the number of
    tiles in each cell (33 x 33 cells); the driver holds no list of pairs.
    """
    hi, lo = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    sized = fps.groupBy(hi.alias("hi"), lo.alias("lo")).count().collect()  # 1089 cells at most
    cells = fps.sparkSession.createDataFrame([(r["hi"], r["lo"], -(-r["count"] // tile_rows)) for r in sized], "hi int, lo int, parts int")
    tiled = (
        fps.select("fp", hi.alias("hi"), lo.alias("lo")).join(F.broadcast(cells), ["hi", "lo"])
        .withColumn("t", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("hi", "lo", "t").agg(F.collect_list("fp").alias("fps"))
    )
    # of two cells the first is the one with the lesser (hi, lo); each pair of tiles has one key
    steps = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius]
    near = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
    other = cells.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("parts").alias("parts2"))
    met = tiled.select("*", near.alias("d")).select("hi", "lo", "t", "fps", (F.col("hi") + F.col("d.x")).alias("hi2"), (F.col("lo") + F.col("d.y")).alias("lo2"))
    met = met.join(F.broadcast(other), ["hi2", "lo2"]).withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    own, its = F.struct("hi", "lo", "t"), F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("t2").alias("t"))
    dealt = met.select(F.least(own, its).alias("p"), F.greatest(own, its).alias("q"), "fps")

    def run(key, batch):
        arrays = [np.asarray(x.values).view(np.uint64) for x in batch.column("fps").combine_chunks()]
        got = linked(arrays[0], arrays[-1], radius)
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    return dealt.groupBy("p", "q").applyInArrow(run, "a long, b long")


def components(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``(fp, component)`` of the fingerprints that link with another one."""
    edges = scratch.save(links(prints.select("fp").distinct(), radius))
    comp = scratch.save(connected_components(edges, scratch).withColumnRenamed("node", "fp"))
    scratch.drop(edges)
    return comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(with_fingerprints(docs, id_col, text_col, width))
    least = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(least, radius, scratch)
    first = least.join(comp, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    named = comp.join(first, "component").select("fp", "component_id")
    ids = scratch.save(least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    scratch.drop(comp, least)
    return prints.join(ids, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row of each component, all columns kept: the one of the least doc_id, null last.

    Rows are told apart by doc_id and text, not by doc_id alone: of two texts
    under one doc_id that are not alike both stay.  Of rows alike in both, and
    of texts alike under the least doc_id, one stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(with_fingerprints(docs, id_col, text_col, width))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h")
    least = scratch.save(prints.groupBy("fp").agg(F.min(order).alias("r")))
    comp = components(least, radius, scratch)
    chosen = least.join(comp, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("r").alias("r"))
    k, h = fresh(docs, "k", "h")
    named = docs.withColumns({k: F.col(id_col).cast("long"), h: text_key(F.col(text_col))})
    win = scratch.save(chosen.select(F.col("r.doc_id").alias("_" + k), F.col("r.h").alias("_" + h)))
    kept = named.join(win, named[k].eqNullSafe(win["_" + k]) & (named[h] == win["_" + h]), "left_semi")
    # rows that repeat whole: only where there are any is one of each chosen, on the join's own partitioning
    again = prints.groupBy("doc_id", "h").count().where("count > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates([k, h])
    scratch.drop(prints, least, comp)
    return kept.select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
