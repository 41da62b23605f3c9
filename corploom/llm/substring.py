"""Substring deduplication of paragraphs that repeat across documents.

Two kinds of paragraph are looked for:

* lines of ``least`` words or more, and paragraphs of several lines between
  blank ones that have as many words together, near-duplicates included:
  MinHash of their five-word shingles, banded for a recall of 0.999 at Jaccard
  0.8; colliding ones are joined to a leader of their band and verified by
  exact Jaccard; those that fail are compared exactly among themselves, tile
  against tile; components of verified links are the clusters;
* content-defined paragraphs, also across lines: every window of ``least``
  words, banded by one MinHash of its runs of ``3 / 5 least`` words, which hangs
  on its own words only; neighbours with one such key are one row.  Windows
  that collide are verified by their words: where all rows of a key agree in
  all of them they need no closer look; the others are compared window by
  window, each window with the first document that holds it.  Equal means equal
  64-bit hashes, so a cluster is the windows of one hash.  Periodic text is no
  exception: a stretch with one key is one row.

The first document (least doc_id) of a cluster keeps its text; everywhere else
the words are removed.  Text repeated inside one document stays.

Words are runs of anything but ASCII white space, compared in lower case.
Defined results: null and empty texts hold nothing and stay; very long texts
are cut up whole; rows of one doc_id are one document; any 64-bit id will do;
null ids come after all others, each text its own document; of clusters that
overlap in a document the ranges are one and the least keeper is named; an
empty table gives an empty result; other columns are ignored, or kept by
``remove``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, free_shuffles, fresh, lean, pieces, table
from .components import connected_components
from .simhash import _Forest

#: Least words of a repeated passage; words of a shingle; Jaccard; bands and rows.
LEAST, SHINGLE, JACCARD, BANDS, ROWS = 50, 5, 0.8, 10, 3
#: Lines in a tile of a crowded band.
TILE = 128
_A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_MIX = np.random.default_rng(17).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[base] = got = tuple(out)
    return got


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_B)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each pair, by differences of prefix sums."""
    power, inverse = _powers(base, len(values) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(values * power[: len(values)], dtype=np.uint64)))
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram(least: int) -> int:
    """Words of the runs that file a window of ``least`` words."""
    return max(1, least * 3 // 5)


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each word, the number of the first word of each line, and of each line after a blank one."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lines, ends = np.unique(np.searchsorted(start, np.concatenate(([0], np.flatnonzero(data == 10)))), return_counts=True)
    blank = np.concatenate(([True], ends[1:] > 1))[: len(lines)]
    kept = lines < len(start)
    return _hash_words(data, start, end), lines[kept], lines[kept & blank]


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """A hash of each word's bytes, of many words at a time."""
    out = [np.zeros(0, np.uint64)]
    k = 0
    while k < len(start):
        m = max(k + 1, int(np.searchsorted(end, start[k] + at_once, "right")))
        own = data[start[k] : end[m - 1]].astype(np.uint64) + np.uint64(1)
        out.append(_spans(own, start[k:m] - start[k], end[k:m] - start[k], _A))
        k = m
    return np.concatenate(out)


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each run of five words, or of all words if there are fewer."""
    n = max(0, len(words) - SHINGLE) + 1
    start = np.arange(n)
    return _spans(words, start, np.minimum(start + SHINGLE, len(words)), _B)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, have = len(values) - width + 1, 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values[:n]


def runs_of_windows(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each run of windows that are filed under one key."""
    n, g = len(words) - least + 1, gram(least)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(words) - g + 1)
    low = _least(_spans(words, at, at + g, _B), least - g + 1)
    start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    return start, np.diff(np.append(start, n)), low[start]


def _identity(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, str]:
    """``(did, rid, text)``: the document a row belongs to, and the row's text in it; from which ``did`` on it stands for a null id; its type.

    Null ids become numbers above all ids: longs where ids leave room for them, else decimals.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("d", "text"))
    top = rows.agg(F.max("d")).first()[0]
    if top is None or top < 1 << 62:
        late, kind, own = 1 << 62, "long", F.expr("(rid & 9223372036854775807L) | 4611686018427387904L")
    else:
        late, kind = 1 << 63, "decimal(20,0)"
        own = F.expr("(rid & 9223372036854775807L)").cast(kind) + F.lit(str(late)).cast(kind)
    return rows.select(F.coalesce(F.col("d").cast(kind), own.cast(kind)).alias("did"), "rid", "text"), late, kind


def _limit(late: int) -> Column:
    return F.lit(late) if late < 1 << 63 else F.lit(str(late)).cast("decimal(20,0)")


def _array(parts: list[np.ndarray], kind) -> pa.Array:
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)).cast(kind, safe=False)


def _blocks(lines: np.ndarray, heads: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines of ``least`` words or more, and of the paragraphs of several lines that have as many."""
    stop = np.append(lines[1:], n)
    ends = np.append(heads[1:], n)
    several = (np.searchsorted(lines, ends) - np.searchsorted(lines, heads) > 1) & (len(heads) > 1)  # a text without blank lines is no paragraph
    s, e = np.concatenate([lines, heads[several]]), np.concatenate([stop, ends[several]])
    long = e - s >= least
    return s[long], e[long]


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both kinds of paragraph of each text, told apart by ``bands``."""
        for b in pieces(batches, 2, 1 << 20):
            rids = b.column(1).to_pylist()
            owner: list[np.ndarray] = []
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            bands: list[np.ndarray | None] = []
            for k, (rid, text) in enumerate(zip(rids, b.column(2).to_pylist())):
                w, lines, heads = word_hashes(text)
                if not len(w):
                    continue
                start, size, key = runs_of_windows(w, least)
                m = len(start)
                own = [np.full(m, rid), start, size, key.view(np.int64), _spans(w, start, start + size - 1 + least, _A).view(np.int64)]
                bands += [None] * m
                s, e = _blocks(lines, heads, len(w), max(least, SHINGLE))
                if len(s):
                    sh = shingles(w)
                    # each paragraph's shingles are those that start in it and end in it
                    x = np.concatenate([np.arange(x, y - SHINGLE + 1) for x, y in zip(s, e)])
                    at = np.cumsum(e - s - SHINGLE + 1) - (e - s - SHINGLE + 1)
                    low = np.stack([np.minimum.reduceat((sh[x] * a) >> np.uint64(16), at) for a in _MIX])
                    keys = np.zeros((BANDS, len(s)), np.uint64)
                    for r in range(ROWS):
                        keys = _mix(keys * np.uint64(_A) + low[r::ROWS] + np.arange(BANDS, dtype=np.uint64)[:, None])
                    q = len(s)
                    more = [np.full(q, rid), s, e - s, np.zeros(q, np.int64), _spans(w, s, e, _A).view(np.int64)]
                    own = [np.concatenate(x) for x in zip(own, more)]
                    bands += list(keys.T.view(np.int64))
                owner.append(np.full(len(own[0]), k))
                for c, x in zip(cols, own):
                    c.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            dids = b.column(0).take(_array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [dids, *[_array(c, k) for c, k in zip(cols, kinds)], pa.array(bands, pa.list_(pa.int64()))],
                ["did", "rid", "start", "n", "key", "dig", "bands"],
            )

    return run


def _short(h: np.ndarray) -> np.ndarray:
    """The upper halves of hashes, to compare a few of them at known places."""
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


_AROUND = "rid long, a int, e int, grams array<long>, sh array<int>"


def _context(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each asked-for range of a text: a hash of each window, or its distinct shingles."""
        for b in pieces(batches, 1, 1 << 20):
            out: list[list] = [[] for _ in range(5)]
            for rid, text, asked in zip(*(b.column(k).to_pylist() for k in range(3))):
                words = word_hashes(text)[0]
                for x in asked:
                    a, e = x["a"], x["e"]
                    if x["line"]:
                        row = (rid, a, e, None, np.unique(_short(shingles(words[a:e]))))
                    else:
                        at = np.arange(a, e - least + 1)
                        row = (rid, a, e, _spans(words, at, at + least, _B).view(np.int64), None)
                    for o, v in zip(out, row):
                        o.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["rid", "a", "e", "grams", "sh"])

    return run


def _alike(rows: list[tuple[int, np.ndarray, bool, bool]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that reach JACCARD, of ``(dig, shingles, upper, settled)``.

    Two uppers are another task's; two that are settled hang on one leader already.
    """
    n = len(rows)
    size = np.array([len(r[1]) for r in rows])
    upper, settled = (np.array([r[k] for r in rows]) for k in (2, 3))
    values, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    held = np.zeros((n, len(values)), np.float32)
    held[np.repeat(np.arange(n), size), at] = 1
    both = held @ held.T
    near = both >= JACCARD * (size[:, None] + size[None, :] - both) - 1e-6
    near &= ~(upper[:, None] & upper[None, :]) & ~(settled[:, None] & settled[None, :])
    forest = _Forest(n)
    forest.add(*np.nonzero(np.triu(near, 1)))
    return [(rows[x][0], rows[y][0]) for x, y in forest.edges]


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_alike`` of each run of rows with one ``g``; a group is a pair of tiles at most."""
    held: list[tuple[int, np.ndarray, bool, bool]] = []
    now = None
    for b in batches:
        edges: list[tuple[int, int]] = []
        sets = b.column(4)
        flat, offset = np.asarray(sets.values), np.asarray(sets.offsets)
        for k, (g, dig, up, settled) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
            if g != now:
                edges += _alike(held) if len(held) > 1 else []
                held, now = [], g
            held.append((dig, flat[offset[k] : offset[k + 1]].copy(), up, settled))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], ["a", "b"])
    edges = _alike(held) if len(held) > 1 else []
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], ["a", "b"])


def _crowded(rest: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges of lines in one band that their leader does not speak for, ``rest(band, dig, settled)``; exact.

    Lines that reach JACCARD have sizes within its ratio, so a line meets its
    own size class and the next one up only.  A crowded class is dealt into
    tiles of unsettled and of settled lines, and tiles are compared in pairs,
    one of them unsettled.
    """
    sized = sets.select("dig", F.floor(F.log(F.size("sh")) / float(np.log(1 / JACCARD))).cast("int").alias("c"))
    near = F.array(F.struct(F.col("c").alias("c"), F.lit(False).alias("up")), F.struct((F.col("c") - 1).alias("c"), F.lit(True).alias("up")))
    asked = rest.join(sized, "dig").select("band", "dig", "settled", F.explode(near).alias("x")).select("band", "dig", "settled", "x.c", "x.up")
    n = asked.groupBy("band", "c").agg(F.count_if(~F.col("settled")).alias("f"), F.count_if(F.col("settled")).alias("s"), F.count_if(~F.col("up")).alias("own")).where("f > 0 and f + s > 1 and own > 0")
    n = scratch.save(n.select("band", "c", F.ceil(F.col("f") / TILE).cast("int").alias("nf"), F.ceil(F.col("s") / TILE).cast("int").alias("ns")))
    dealt = asked.join(n, ["band", "c"]).withColumn("t", F.pmod(F.xxhash64("dig", F.lit(3)), F.when(F.col("settled"), F.col("ns")).otherwise(F.col("nf"))).cast("int"))
    partner = F.expr(
        "if(settled, transform(sequence(0, nf - 1), o -> struct(2 as k, o as p, t as q)),"
        " concat(transform(sequence(0, nf - 1), o -> struct(1 as k, least(t, o) as p, greatest(t, o) as q)),"
        " if(ns > 0, transform(sequence(0, greatest(ns, 1) - 1), o -> struct(2 as k, t as p, o as q)), array())))"
    )
    keyed = dealt.withColumn("x", F.explode(partner)).select(F.xxhash64("band", "c", "x.k", "x.p", "x.q").alias("g"), "dig", "up", "settled")
    tasks = keyed.join(sets, "dig").select("g", "dig", "up", "settled", "sh")
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(4 * parts, "g").sortWithinPartitions("g").mapInArrow(lean(_crowds), "a long, b long")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> tuple[DataFrame, int]:
    """``(did, rid, first_word, n_words, kept_doc_id)``: merged ranges of words to remove, by row identity; from which ``did`` on ids are null."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    rows, late, kind = _identity(docs, id_col, text_col)
    again = scratch.save(rows.groupBy("rid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rid"))
    if not again.isEmpty():  # rows that repeat whole count once
        rows = rows.join(again, "rid", "left_anti").unionByName(rows.join(again, "rid", "left_semi").dropDuplicates(["rid"]))
        rows = scratch.save(rows.select("did", "rid", "text"))
    cut = scratch.save(rows.mapInArrow(lean(_cut(least)), f"did {kind}, rid long, start int, n int, key long, dig long, bands array<long>"))
    runs = cut.where("bands is null").drop("bands")
    lines = scratch.save(cut.where("bands is not null").select("did", "rid", "start", "n", F.col("dig").alias("key"), "bands"))

    # keys that several documents hold, and what differs under one key
    shared = runs.groupBy("key").agg(F.min("did").alias("keeper"), F.max("did").alias("last")).where("keeper <> last").select("key")
    met = scratch.save(runs.join(scratch.save(shared), "key"))
    scratch.drop(cut)
    free_shuffles(spark)
    kinds = met.groupBy("dig").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min(F.struct("did", "rid", "start")).alias("f"), F.max("did").alias("last"))
    kinds = scratch.save(kinds.select("dig", "key", "n", F.col("f.did").alias("least"), "last", F.col("f.rid").alias("rid"), F.col("f.start").alias("a")))
    split = scratch.save(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    apart = kinds.join(split, "key", "left_semi").select("dig", "least", "last", "rid", "a", (F.col("a") + F.col("n") + (least - 1)).alias("e"))
    apart = scratch.save(apart)

    # lines that share a band
    classes = lines.groupBy(F.col("key").alias("dig")).agg(F.min("did").alias("least"), F.min("rid").alias("rid_low"), F.first("bands").alias("bands"))
    spots = lines.select(F.col("key").alias("dig"), F.col("rid").alias("rid_low"), "start", "n").groupBy("dig", "rid_low").agg(F.min("start").alias("a"), F.first("n").alias("n"))
    classes = scratch.save(classes)
    banded = classes.select("dig", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.min("dig").alias("leader"), F.max("dig").alias("other")).where("leader <> other").drop("other")
    member = scratch.save(banded.join(groups, "band").select("band", "dig", "leader"))
    involved = member.select("dig").distinct().join(classes.select("dig", "rid_low"), "dig").join(spots, ["dig", "rid_low"])
    involved = scratch.save(involved.select("dig", F.col("rid_low").alias("rid"), "a", (F.col("a") + F.col("n")).alias("e")))

    # the words of all of these, by one pass over the texts
    ask = (
        apart.select("rid", "a", "e", F.lit(False).alias("line"))
        .unionByName(involved.select("rid", "a", "e", F.lit(True).alias("line")))
        .distinct()
    )
    asked = scratch.save(ask.groupBy("rid").agg(F.collect_list(F.struct("a", "e", "line")).alias("asked")))  # ranges of one text
    texts = rows.select(F.col("rid").alias("r"), "text").join(asked, F.col("r") == F.col("rid")).select("rid", "text", "asked")
    free_shuffles(spark)
    found = scratch.save(texts.mapInArrow(lean(_context(least)), _AROUND))
    free_shuffles(spark)
    # each window and the first document that holds it
    held = apart.join(found.where("grams is not null").select("rid", "a", "e", "grams"), ["rid", "a", "e"]).select("dig", "least", "last", F.posexplode("grams").alias("at", "gram"))
    held = scratch.save(held)
    keepers = scratch.save(held.groupBy("gram").agg(F.min("least").alias("keeper")))
    again = held.join(keepers, "gram").where("keeper <> last").select("dig", "at", "keeper")
    along = Window.partitionBy("dig", "keeper").orderBy("at")  # one run's windows
    again = again.withColumn("g", F.col("at") - F.row_number().over(along)).groupBy("dig", "keeper", "g").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    alike = kinds.join(split, "key", "left_anti").select("dig", F.col("least").alias("keeper"), F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
    ranges = scratch.save(again.drop("g").unionByName(alike))
    scratch.drop(held, keepers)
    free_shuffles(spark)
    passages = met.join(ranges, "dig").where("did <> keeper")
    passages = scratch.save(passages.select("did", "rid", (F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") + least).alias("e"), "keeper"))
    free_shuffles(spark)

    # near-duplicate lines: a star round each leader, then all that failed theirs, tile against tile
    sh = found.where("sh is not null").select("rid", "a", "e", "sh")
    sets = scratch.save(involved.join(sh, ["rid", "a", "e"]).select("dig", "sh").dropDuplicates(["dig"]))
    pairs = member.where("dig <> leader").select("dig", "leader").distinct()
    scored = pairs.join(sets, "dig").join(sets.select(F.col("dig").alias("leader"), F.col("sh").alias("sh2")), "leader")
    both_n = F.size(F.array_intersect("sh", "sh2"))
    scored = scratch.save(scored.select("dig", "leader", (both_n >= F.lit(JACCARD) * (F.size("sh") + F.size("sh2") - both_n)).alias("ok")))
    judged = member.join(scored, ["dig", "leader"], "left").select("band", "dig", F.coalesce("ok", F.lit(True)).alias("settled"))
    open_bands = judged.where("not settled").select("band").distinct()
    rest = judged.join(open_bands, "band", "left_semi")
    rest = scratch.save(rest)
    free_shuffles(spark)
    edges = scored.where("ok").select(F.col("dig").alias("a"), F.col("leader").alias("b")).unionByName(_crowded(rest, sets, scratch))
    comp = scratch.save(connected_components(scratch.save(edges), scratch).select(F.col("node").alias("dig"), "component"))
    keep = comp.join(classes.select("dig", "least"), "dig").groupBy("component").agg(F.min("least").alias("keeper"))
    named = scratch.save(comp.join(keep, "component").select("dig", "keeper"))
    near = lines.select("did", "rid", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("e"), F.col("key").alias("dig")).join(named, "dig").where("did <> keeper").drop("dig")

    # ranges that overlap or touch are one
    spans = scratch.save(passages.unionByName(near))
    scratch.drop(met, kinds, apart, ranges, found, asked, classes, lines)
    order = Window.partitionBy("rid").orderBy("a", "e", "keeper")  # a document's own ranges
    merged = spans.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    merged = merged.withColumn("g", F.sum((F.col("reach").isNull() | (F.col("a") > F.col("reach"))).cast("int")).over(order))
    out = merged.groupBy("did", "rid", "g").agg(F.min("a").alias("first_word"), F.max("e").alias("end"), F.min("keeper").alias("kept_doc_id"))
    return out.select("did", "rid", "first_word", (F.col("end") - F.col("first_word")).cast("int").alias("n_words"), "kept_doc_id"), late


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, first_word, n_words, kept_doc_id)``: the ranges of words that ``remove`` takes out."""
    found, late = repeated(docs, id_col, text_col, least)
    named = lambda c: F.when(F.col(c) < _limit(late), F.col(c)).cast("long")
    return found.select(named("did").alias("doc_id"), "first_word", "n_words", named("kept_doc_id").alias("kept_doc_id"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 2):
        texts = []
        for text, ranges in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            at = [m.span() for m in _WORD.finditer(text)]
            out, last = [], 0
            for r in sorted(ranges, key=lambda r: r["a"]):
                out.append(text[last : at[r["a"]][0]])
                last = at[r["e"] - 1][1]
            out.append(text[last:])
            texts.append("".join(out).strip())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["d", "r", "new"])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` without repeated passages; all columns kept, ``n_chars`` counted anew where the text changed.

    A document of which nothing is left goes; one that was empty before stays.
    Rows are known by doc_id and a hash of both, so that equal hashes of two documents do no harm.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    found, late = repeated(docs, id_col, text_col, least)
    real = F.when(F.col("did") < _limit(late), F.col("did")).cast("long")
    ranges = F.collect_list(F.struct(F.col("first_word").alias("a"), (F.col("first_word") + F.col("n_words")).alias("e")))  # of one text
    spans = scratch.save(found.groupBy(real.alias("d"), F.col("rid").alias("r")).agg(ranges.alias("ranges")))
    d, r, new = fresh(docs, "d", "r", "new")
    key = F.col(id_col).cast("long")
    named = docs.withColumns({d: key, r: F.xxhash64(key, F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    texts = named.select(F.col(d).alias("_d"), F.col(r).alias("_r"), F.col(text_col).cast("string").alias("text"))
    hit = texts.join(spans, F.col("_d").eqNullSafe(F.col("d")) & (F.col("_r") == F.col("r"))).dropDuplicates(["d", "r"]).select("d", "r", "text", "ranges")
    cut = scratch.save(hit.mapInArrow(lean(_strip), "d long, r long, new string").select(F.col("d").alias("_" + d), F.col("r").alias("_" + r), F.col("new").alias(new)))
    out = named.join(cut, named[d].eqNullSafe(cut["_" + d]) & (named[r] == cut["_" + r]), "left").where(F.col(new).isNull() | (F.col(new) != ""))
    fixed = {text_col: F.coalesce(new, text_col)}
    if "n_chars" in docs.columns:
        fixed["n_chars"] = F.when(F.col(new).isNotNull(), F.length(new).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.withColumns(fixed).select(*docs.columns)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
