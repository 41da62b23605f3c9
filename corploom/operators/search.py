"""Search of a large corpus from postings of trigrams, in place of a scan of all texts.

An index is three tables under one folder: ``postings`` (which texts hold a
trigram of lower-case text, once each, as lists of keys, a row for each trigram
of a few megabytes of texts, in folders by a hash of the trigram and sorted by
it), ``counts`` (how many texts hold each) and ``texts`` in order of
key, in files whose ranges of keys don't overlap.  A needle's rarest trigrams
say which texts may hold it; those are read in order of key, a bounded number at
a time, and looked at line by line until enough lines are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import pieces
from . import corpus

#: Folders of postings; trigrams of a needle that are intersected; texts read at a time for each line that is wanted.
FOLDERS, RAREST, AHEAD = 64, 3, 8

#: Bytes of text whose postings are made together; characters of a longer text that are numbered at once.
AT_ONCE = 4 << 20


def grams(text: str) -> set[str]:
    """Trigrams of the lines of a text."""
    return {line[k : k + 3] for line in text.split("\n") for k in range(len(line) - 2)}


def _numbers(points: np.ndarray, owner: np.ndarray, number: np.ndarray, base: int, texts: int) -> np.ndarray:
    """Trigrams without a line's end, each with its text, as sorted distinct numbers."""
    code = number[points]
    gram = (code[:-2] * base + code[1:-1]) * base + code[2:]
    end = points == 10
    both = (gram * texts + owner[:-2])[~(end[:-2] | end[1:-1] | end[2:])]
    both.sort()
    return both[np.flatnonzero(np.diff(both, prepend=-1))]


def _lists(keys: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """``gram, n, keys``: each trigram of some texts once, with the keys of those that hold it."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    number = np.zeros(0x110000, np.int64)
    number[points] = 1
    chars = np.flatnonzero(number)
    number[chars] = np.arange(len(chars))
    base = len(chars)
    if base**3 * len(texts) >= 1 << 63:  # never with one text
        half = len(texts) // 2
        yield from _lists(keys[:half], texts[:half])
        yield from _lists(keys[half:], texts[half:])
        return
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])[: len(points)]
    some = [_numbers(points[at : at + AT_ONCE + 2], owner[at : at + AT_ONCE + 2], number, base, len(texts)) for at in range(0, len(points) - 2, AT_ONCE)]
    both = some[0] if len(some) == 1 else np.unique(np.concatenate([np.zeros(0, np.int64), *some]))
    gram, owner = np.divmod(both, len(texts))
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    gram = gram[first]
    three = chars[np.stack([gram // base**2, gram // base % base, gram % base], 1)].astype(np.uint32)
    widths = 1 + (three > 0x7F).astype(np.int32) + (three > 0x7FF) + (three > 0xFFFF)  # bytes in UTF-8
    ends = np.concatenate(([0], np.cumsum(widths.sum(1)))).astype(np.int32)
    names = pa.StringArray.from_buffers(len(gram), pa.py_buffer(ends), pa.py_buffer(three.tobytes().decode("utf-32-le").encode()))
    at = np.append(first, len(both)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at), keys.take(pa.array(owner)))], ["gram", "n", "keys"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 1, AT_ONCE):
        yield from _lists(b.column(0), b.column(1).to_pylist())


def build(docs: DataFrame, path: str, key: str, text: str) -> None:
    """Write the index of ``docs`` under ``path``, in place of an older one; keys should be of one text each."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts.repartitionByRange(parts, "key").sortWithinPartitions("key").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/texts")
    kind = texts.schema["key"].dataType.simpleString()
    held = spark.read.parquet(f"{path}/texts").select("key", F.lower("text")).mapInArrow(_rows, f"gram string, n int, keys array<{kind}>")
    folder = F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int")
    # a trigram of most texts is dealt by a list's first key, too, so its postings meet in no task
    spread = F.pmod(F.xxhash64(F.element_at("keys", 1)), F.lit(8))
    held.withColumn("folder", folder).repartition(parts, "folder", spread).sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").option("compression", "zstd").parquet(f"{path}/postings")
    counted = _table(spark, path, "postings").groupBy("folder", "gram").agg(F.sum("n").alias("n"))
    counted.repartition("folder").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/counts")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/texts").schema["key"].dataType.simpleString()
    schema = {"postings": f"gram string, n int, keys array<{kind}>, folder int", "counts": "gram string, n long, folder int"}[name]
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _named(spark: SparkSession, table: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of some trigrams; only their folders are read."""
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in wanted])).alias("gram"))
    folders = [r[0] for r in asked.select(F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int")).distinct().collect()]
    return table.where(F.col("folder").isin(*folders) & F.col("gram").isin(*wanted))


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """``key`` of the texts that hold the needle's rarest trigrams; None if it has no trigram to go by."""
    wanted = sorted(grams(needle.lower()))
    if not wanted:
        return None
    counts = {r["gram"]: r["n"] for r in _named(spark, _table(spark, path, "counts"), wanted).collect()}  # one row a trigram of the needle
    postings = _table(spark, path, "postings")
    if len(counts) < len(wanted):
        return postings.select(F.explode("keys").alias("key")).limit(0)
    rarest = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
    held = _named(spark, postings, rarest).select(F.explode("keys").alias("key"))
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("key")


def search(spark: SparkSession, path: str, needle: str, limit: int = 30, width: int = 240) -> DataFrame:
    """``key, line_no, snippet``: what ``corpus.search_text`` finds, from the index; needles of fewer than three characters are looked for in all texts."""
    texts = spark.read.parquet(f"{path}/texts")
    maybe = candidates(spark, path, needle)
    if maybe is None or "\n" in needle:
        return corpus.search_text(texts, "key", "text", needle, limit, width)
    found = corpus.search_text(texts.limit(0), "key", "text", needle, limit, width)
    schema, rows, last = found.schema, [], None
    while len(rows) < limit:
        ahead = maybe if last is None else maybe.where(F.col("key") > last)
        keys = [r["key"] for r in ahead.orderBy("key").limit(AHEAD * limit).collect()]
        if not keys:
            break
        own = texts.where(F.col("key").isin(*keys) & F.col("key").between(keys[0], keys[-1]))  # both reach the scan
        rows += [tuple(r) for r in corpus.search_text(own, "key", "text", needle, limit - len(rows), width).collect()]
        last = keys[-1]
    return spark.createDataFrame(rows, schema)
