"""Target-distribution importance resampling with a dictionary of distinct features.

Features are runs of one to ``LONGEST`` consecutive words.  Each task counts the
distinct features of a stretch of text and sends them, with their counts, to
the part of the dictionary that owns them, as compressed blocks of sorted
strings, in ``ROUNDS`` rounds that share them out by hash; there equal strings of all stretches become one entry, each entry's
bytes are hashed once, and counts are added up by bucket.  A bucket's gain, the
logarithm of its smoothed share in the target over that in the corpus, is
joined back to the documents' own feature counts by bucket: the gains are a
table of ``BUCKETS`` rows, whatever the corpus, so it goes to the tasks, while
no document's features are shuffled.  There a feature's bucket is put together
from the checksums of its words, each hashed once for a stretch, because
checksums of joined strings follow from those of their parts.

Draws perturb weights by Gumbel noise that hangs on the document's id alone, so
the highest scores are a sample without replacement.

Defined results: null and empty texts have no features and weight 0; very long
texts are read whole, a stretch at a time; equal scores go to the smaller
doc_id, null ids after all others; rows of one id share their noise; a null id
is hashed as the empty string; repeated rows each get a row, and ranks of their
own; an empty table gives an empty result, an empty target only the corpus'
own rarity; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_shuffles, lean, pieces, table
from .words import SLOT, Vocabulary, flat, numbered, slot_sums, spans, stretches

#: Words of a feature at most, buckets, words that a document must have to be drawn, percent of them that are drawn, seed of the noise.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, "42"
#: Words of a stretch (their numbers take 21 bits), bytes of text read at once, bytes of distinct features in a part of the dictionary,
#: rounds that the dictionary is made in: each sends the features of its own hashes, so that a part of all blocks is on disk at a time.
STRETCH, AT_ONCE, PART, ROUNDS = 1 << 19, 4 << 20, 24 << 20, 2
_BITS = np.uint64(21)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _features(v: Vocabulary, doc: np.ndarray, own: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the distinct features that begin among the first ``own`` words, as word numbers of 21 bits each, in byte order, and their counts."""
    ids = v.ids.astype(np.uint64)
    for n in range(1, LONGEST + 1):
        m = min(own, len(ids) - n + 1)
        if m < 1:
            return
        key = ids[:m]
        for k in range(1, n):
            key = (key << _BITS) | ids[k : k + m]
        key = np.sort(key[doc[n - 1 : n - 1 + m] == doc[:m]])
        if len(key):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield n, key[first], np.diff(np.append(first, len(key)))


def _word(key: np.ndarray, n: int, k: int) -> np.ndarray:
    """The number of word ``k`` of features of ``n`` words."""
    return ((key >> (_BITS * np.uint64(n - 1 - k))) & np.uint64((1 << 21) - 1)).astype(np.int64)


def _blocks(parts: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block for each stretch and part of this round: numbers of entries by length, counts, and strings with a space after each word."""
        pack = zstandard.ZstdCompressor(level=3)
        for b in pieces(batches, 0, AT_ONCE):
            data, off = flat(b.column(0))
            start, end, doc = spans(data, off, _IS_WORD)
            for a, z, reach in stretches(len(start), STRETCH, LONGEST - 1):
                v = Vocabulary(data, start[a:reach], end[a:reach], _IS_WORD)
                h = _mix(_hashes(v.words).astype(np.uint64) + np.uint64(1))
                kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
                for n, key, count in _features(v, doc[a:reach], z - a):
                    x = h[_word(key, n, 0)]
                    for k in range(1, n):
                        x = x * np.uint64(0xD1342543DE82EF95) + h[_word(key, n, k)]
                    to = (_mix(x) >> np.uint64(20)) % np.uint64(parts * ROUNDS)
                    mine = to // np.uint64(parts) == turn
                    key, count, to = key[mine], count[mine], (to[mine] % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
                    rows = np.stack([_word(key, n, k) for k in range(n)], axis=1)
                    order = np.argsort(to, kind="stable")
                    kept.append((rows[order], count[order], to[order], np.searchsorted(to[order], np.arange(parts + 1))))
                out: list[tuple[int, bytes]] = []
                for p in range(parts):
                    mine = [(rows[cut[p] : cut[p + 1]], count[cut[p] : cut[p + 1]]) for rows, count, _, cut in kept]
                    sizes = np.array([len(c) for _, c in mine] + [0] * (LONGEST - len(mine)), np.int32)
                    if sizes.sum():
                        text = v.joined(np.concatenate([r.ravel() for r, _ in mine]))
                        counts = np.concatenate([c for _, c in mine]).astype(np.uint32)
                        out.append((p, pack.compress(sizes.tobytes() + counts.tobytes() + text.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "block"])

    return run


def _entries(blocks: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings of the blocks, and the sum of each one's counts."""
    texts, ends, counts, base = [], [], [], 0
    unpack = zstandard.ZstdDecompressor()
    for x in blocks:
        raw = np.frombuffer(unpack.decompress(x), np.uint8)
        sizes = raw[: 4 * LONGEST].view(np.int32)
        at = 4 * (LONGEST + int(sizes.sum()))
        counts.append(raw[4 * LONGEST : at].view(np.uint32))
        text = raw[at:]
        space = np.flatnonzero(text == 32) + 1  # words' ends; those of entries are every n-th
        skip = 0
        for n, m in enumerate(sizes.tolist(), 1):
            ends.append(space[skip + n - 1 : skip + n * m : n] + base)
            skip += n * m
        texts.append(text)
        base += len(text)
    at = np.concatenate([[0], *ends]).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.concatenate(texts))])
    known = strings.dictionary_encode()
    sums = np.bincount(known.indices.to_numpy(), np.concatenate(counts), len(known.dictionary))  # exact below 2 ** 53
    return known.dictionary, sums.astype(np.int64)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    held, now = [], None
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if p != now and held:
                yield held
                held = []
            now = p
            held.append(x)
    if held:
        yield held


def _hashes(strings: pa.Array) -> np.ndarray:
    """crc32 of each string without the space at its end."""
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist()
    text, crc32 = memoryview(strings.buffers()[2]), zlib.crc32
    return np.array([crc32(text[a : b - 1]) for a, b in zip(at, at[1:])], np.int64)


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for blocks in _by_part(batches):
        strings, n = _entries(blocks)
        bucket = (_hashes(strings) % BUCKETS).astype(np.int32)
        for k in range(0, len(n), 1 << 16):
            text = pa.array([s[:-1].decode("utf-8", "replace") for s in strings.slice(k, 1 << 16).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text, pa.array(bucket[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], ["feature", "bucket", "n"])


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(-(-BUCKETS // SLOT) * SLOT, np.int64)
    for blocks in _by_part(batches):
        strings, n = _entries(blocks)
        sums[:BUCKETS] += np.bincount(_hashes(strings) % BUCKETS, n, BUCKETS).astype(np.int64)
    held = np.flatnonzero(sums.reshape(-1, SLOT).any(axis=1))
    values = pa.FixedSizeListArray.from_arrays(sums.reshape(-1, SLOT)[held].ravel(), SLOT).cast(pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), values], ["slot", "sums"])


def _parts(texts: DataFrame, text_col: str) -> int:
    """Parts of a round: so many that the distinct features of one fit in memory, were all features distinct."""
    size = texts.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size * LONGEST * (LONGEST + 1) // 2 // (PART * ROUNDS)))


def _dealt(texts: DataFrame, text_col: str, parts: int, turn: int) -> DataFrame:
    """A round's blocks, sorted by part."""
    blocks = texts.select(F.col(text_col).cast("string")).mapInArrow(lean(_blocks(parts, turn)), "part int, block binary")
    return blocks.repartition(parts, "part").sortWithinPartitions("part")


def dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(feature, bucket, n)``: every distinct feature of all texts, once."""
    parts = _parts(texts, text_col)
    rows = [_dealt(texts, text_col, parts, turn).mapInArrow(lean(_entry_rows), "feature string, bucket int, n long") for turn in range(ROUNDS)]
    return reduce(DataFrame.unionByName, rows)


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(bucket, n)``: the dictionary's counts added up by bucket, a round at a time.

    A task sends its sums as rows of many buckets, so few rows meet in the end.
    """
    scratch, parts = Scratch(texts.sparkSession, "resampling"), _parts(texts, text_col)
    sums = []
    for turn in range(ROUNDS):
        sums.append(scratch.save(_dealt(texts, text_col, parts, turn).mapInArrow(lean(_bucket_rows), "slot int, sums array<long>")))
        free_shuffles(texts.sparkSession)  # the round's blocks go before the next one's come
    return reduce(DataFrame.unionByName, sums).repartition("slot").mapInArrow(lean(slot_sums), "place int, n long").withColumnRenamed("place", "bucket")


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """``(bucket, gain)`` of every bucket, from both sides' ``bucket_counts``."""
    spark = corpus.sparkSession
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    each = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    each = each.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    whole = each.agg(F.sum("s").alias("ss"), F.sum("t").alias("tt"))  # one row
    d = lambda c, more: (F.col(c) + more).cast("double")
    ratio = d("t", 1) * d("ss", BUCKETS) / (d("s", 1) * d("tt", BUCKETS))
    return each.join(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


@lru_cache(maxsize=4096)
def _shift(n: int) -> np.ndarray:
    """Four tables of 256: what appending ``n`` bytes makes of each byte of a crc32, apart from their own."""
    basis = np.array([zlib.crc32(b"\0", 1 << k) ^ zlib.crc32(b"\0", 0) for k in range(32)], np.uint64)  # by one zero byte
    out, step = np.array([1 << k for k in range(32)], np.uint64), basis

    def through(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
        bits = (x[..., None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
        return np.bitwise_xor.reduce(bits * columns, axis=-1)

    while n:
        if n & 1:
            out = through(out, step)
        step = through(step, step)
        n >>= 1
    values = np.arange(256, dtype=np.uint64)
    return np.stack([through(values << np.uint64(8 * k), out) for k in range(4)]).astype(np.uint32)


def _joined(crc: np.ndarray, tables: np.ndarray, kind: np.ndarray, more: np.ndarray) -> np.ndarray:
    """crc32 of joined strings: of the left ones ``crc``, of the right ones ``more``, whose lengths have the tables ``tables[kind]``."""
    out = more
    for k in range(4):
        out = out ^ tables[kind, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _weigher(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1, AT_ONCE):
            data, off = flat(b.column(1))
            start, end, doc = spans(data, off, _IS_WORD)
            words = np.bincount(doc, minlength=b.num_rows).astype(np.int64)
            weight, features = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for a, z, reach in stretches(len(start), STRETCH, LONGEST - 1):
                v = Vocabulary(data, start[a:reach], end[a:reach], _IS_WORD)
                plain = _hashes(v.words).astype(np.uint32)
                lengths, kind = np.unique(np.diff(v.at) - 1, return_inverse=True)
                tables, space = np.stack([_shift(n) for n in lengths.tolist()]), _shift(1)[None]
                crc, none, blank = plain[v.ids], np.zeros(1, np.int64), np.uint32(zlib.crc32(b" "))
                own, whole = doc[a:reach], crc
                for n in range(1, LONGEST + 1):
                    m = min(z - a, len(own) - n + 1)
                    if m < 1:
                        break
                    if n > 1:
                        right = v.ids[n - 1 : n - 1 + m]
                        whole = _joined(_joined(whole[:m], space, none, blank), tables, kind[right], plain[right])
                    else:
                        whole = whole[:m]
                    inside = own[n - 1 : n - 1 + m] == own[:m]
                    at, got = own[:m][inside], gain[whole[inside] % np.uint32(BUCKETS)]
                    lo, hi = own[0], own[m - 1] + 1
                    weight[lo:hi] += np.bincount(at - lo, got, hi - lo).astype(np.int64)
                    features[lo:hi] += np.bincount(at - lo, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` for every row; ``gain`` has ``BUCKETS`` rows at most."""
    got = np.zeros(BUCKETS, np.int64)
    for r in gain.collect():  # BUCKETS rows, whatever the corpus
        got[r["bucket"]] = r["gain"]
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return src.mapInArrow(lean(_weigher(got)), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 times Gumbel noise) of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for every row of ``docs``; ``rank`` is null where it isn't drawn."""
    scratch = Scratch(docs.sparkSession, "resampling")
    corpus, wanted = scratch.save(bucket_counts(docs, text_col)), scratch.save(bucket_counts(target, target_text_col))
    weighed = weigh(docs, gains(corpus, wanted), id_col, text_col)
    scored = scratch.save(weighed.withColumns({"score": F.col("weight") + noise(F.col("doc_id")), "row": F.monotonically_increasing_id()}))
    may = F.col("n_words") >= least_words
    drawn = percent * scored.where(may).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranked = numbered(scored.where(may).select("row", "score", "doc_id"), order, "rank", scratch).where(F.col("rank") <= drawn).select(F.col("row").alias("r"), "rank")
    return scored.join(ranked, F.col("row") == F.col("r"), "left").select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
