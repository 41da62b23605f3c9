"""Phrase collocation mining: sketch upper bounds, automata for exact counts.

Three passes over the texts, everything for each language apart:

* every run of one to ``LONGEST`` words inside a piece is hashed to a cell of a
  sketch; tasks send the cells they met in compressed blocks, and a block's sums
  become one bit a cell: whether it reached ``least``.  A sum is an upper bound
  of each of its phrases' counts, so no frequent phrase has a cell without bit;
* phrases whose cell, and the cells of all phrases inside them, have their bits
  are candidates; the same pass counts them by their 64-bit hashes, and those
  that reach ``least`` are kept, with all words' number;
* what is reported, a bounded number of phrases and the two parts of each, is
  counted again: a task gives every word a character of its own and compiles the
  phrases into one automaton a language; texts become strings of such characters
  in which a guard character stands wherever a piece or a text ends or a word is
  in none, so no match crosses it, and the automaton counts every match,
  overlapping ones too.  A count that differs is an error, never a result.

A sketch that is too small for its corpus (its bits are bounded by ``MOST_BITS``)
gives more candidates, never other results; the texts are read three times.

Defined results: null and empty texts hold nothing; a null language is ``und``;
very long texts are read whole, a stretch at a time; repeated rows count each
time; ties in score go to the more frequent phrase, then to the first in byte
order; a language without phrases has no rows; an empty table gives an empty
result; other columns are ignored.  Candidates are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, pieces, resident, table
from .words import SLOT, Vocabulary, flat, slot_sums, spans, stretches

#: Words of a phrase, its least count, percent of its count at which a longer phrase makes it idle, phrases of a language in the report.
SHORTEST, LONGEST, LEAST, IDLE, TOP = 2, 5, 100, 100, 2000
#: Words of a stretch, bytes of text read at once, cells of a block, bits of a cell's number at least and at most, hashes remembered by a task.
STRETCH, AT_ONCE, BLOCK_BITS, LEAST_BITS, MOST_BITS, REMEMBERED = 1 << 19, 4 << 20, 20, 20, 29, 1 << 22
#: Bytes of text to a part of the candidates.
PART = 64 << 20
#: Candidates of a group, and of one whose words may be more than there are characters.
GROUP, SMALL_GROUP, CHARACTERS = 1 << 19, 1 << 17, 1_000_000
#: A cut's score; its products take up to 38 digits.
SCORE = "cast(1000 * a as decimal(18,0)) * cast(n as decimal(20,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
_BREAK = np.zeros(256, bool)
_BREAK[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_IS_WORD = ~_BREAK
_IS_WORD[[32, 9]] = False


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Stretch:
    """Words of a stretch: their numbers, hashes, pieces, languages, and how many of them begin here."""

    def __init__(self, v: Vocabulary, piece: np.ndarray, lang: np.ndarray, own: int):
        self.v, self.piece, self.lang, self.own = v, piece, lang, own

    def runs(self, seed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length, by its language's seed, the places of phrases, as far as the caller lets the last length's ``ok`` stand, and their hashes.

        The caller sends back which of the places count, all if it sends nothing.
        """
        word = np.array([xxhash.xxh64_intdigest(w) for w in self.v.listed()], np.uint64)[self.v.ids]
        at, h = np.arange(len(word)), _mix(seed[self.lang] + word)
        for n in range(1, LONGEST + 1):
            ok = yield n, at, h
            at, h = (at, h) if ok is None else (at[ok], h[ok])
            good = np.zeros(len(word) + 1, bool)
            good[at] = True
            more = good[at + 1] & (at + n < len(word))  # the same length holds at the next place
            more[more] = self.piece[at[more] + n] == self.piece[at[more]]
            at = at[more]
            h = _mix(h[more] + word[at + n])


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[str], _Stretch]]:
    """Each stretch, with the names of its languages' numbers."""
    for b in pieces(batches, 1, AT_ONCE):
        langs = b.column(0).dictionary_encode()
        names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        data, off = flat(b.column(1))
        start, end, doc = spans(data, off, _IS_WORD)
        breaks = np.cumsum(_BREAK[data], dtype=np.int64)
        piece = breaks[start] + doc  # a text's number moves it, so texts share none
        for a, z, reach in stretches(len(start), most, LONGEST - 1):
            v = Vocabulary(data, start[a:reach], end[a:reach], _IS_WORD)
            yield names, _Stretch(v, piece[a:reach], lang[doc[a:reach]], z - a)


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in names], np.uint64)


def _cells(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each stretch and block of the sketch the cells met, as differences, and how often."""
        pack, inner = zstandard.ZstdCompressor(level=1), min(bits, BLOCK_BITS)
        for names, s in _stretches(batches, STRETCH):
            met = [(h[at < s.own] >> np.uint64(64 - bits)).astype(np.uint32) for _, at, h in s.runs(_seeds(names))]
            cells = np.sort(np.concatenate(met))
            first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            count = np.diff(np.append(first, len(cells))).astype(np.uint32)
            cells = cells[first]
            cut = np.searchsorted(cells, np.arange((1 << (bits - inner)) + 1, dtype=np.uint64) << np.uint64(inner))
            out: list[tuple[int, bytes]] = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                own = cells[cut[k] : cut[k + 1]] - np.uint32(k << inner)
                out.append((k, pack.compress(np.diff(own, prepend=np.uint32(0)).tobytes() + count[cut[k] : cut[k + 1]].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["block", "cells"])

    return run


def _reached(least: int, inner: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of each block."""
        unpack, now, sums = zstandard.ZstdDecompressor(), None, np.zeros(1 << inner, np.int64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["block", "bits"])
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    if now is not None:
                        yield row()
                    now = k
                    sums[:] = 0
                both = np.frombuffer(unpack.decompress(x), np.uint32)
                n = len(both) // 2
                sums[np.cumsum(both[:n], dtype=np.uint32)] += both[n:]  # a block names a cell once
        if now is not None:
            yield row()

    return run


def sketch(texts: DataFrame, least: int, bits: int) -> np.ndarray:
    """One bit for each of ``2 ** bits`` cells, at most 64 MB."""
    inner = min(bits, BLOCK_BITS)
    blocks = texts.mapInArrow(lean(_cells(bits)), "block int, cells binary")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << (bits - inner))
    reached = blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(lean(_reached(least, inner)), "block int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << inner) // 8
    for r in reached.toLocalIterator():  # of fixed size
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


_CANDIDATE = ["part", "lang", "phrases", "words", "keys", "counts"]


def _candidates(sent, bits: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(part, lang, phrases, words, keys, counts)``: candidates of a language, a line each, once for a while, with their hashes; hashes and how often they were met; at the end the numbers of all words."""
        table = sent.value
        seen, often = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        met: list[tuple[np.ndarray, np.ndarray]] = []
        words: dict[str, int] = {}
        held: dict[tuple[int, str], tuple[bytearray, bytearray]] = {}
        size = 0

        def fold() -> None:
            nonlocal seen, often
            keys = np.concatenate([seen, *(k for k, _ in met)])
            counts = np.concatenate([often, *(n for _, n in met)])
            met.clear()
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            seen, often = keys[first], np.add.reduceat(counts, first) if len(first) else counts

        def counted() -> pa.RecordBatch:
            part = ((seen >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            many = np.bincount(part, minlength=parts)
            ends = np.cumsum(many)
            own = np.flatnonzero(many)
            cut = lambda x: pa.array([x[order[e - n : e]].tobytes() for n, e in zip(many[own].tolist(), ends[own].tolist())], pa.binary())
            none = len(own)
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.nulls(none, pa.string()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int64()), cut(seen), cut(often)], _CANDIDATE)

        def rows() -> pa.RecordBatch:
            part, lang = [k for k, _ in held], [x for _, x in held]
            none = pa.nulls(len(held), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(lang, pa.string()), pa.array([x.decode() for x, _ in held.values()], pa.string()), none, pa.array([bytes(k) for _, k in held.values()], pa.binary()), pa.nulls(len(held), pa.binary())], _CANDIDATE)

        for names, s in _stretches(batches, STRETCH):
            for k, n in enumerate(np.bincount(s.lang[: s.own], minlength=len(names)).tolist()):
                words[names[k]] = words.get(names[k], 0) + n
            runs, ok = s.runs(_seeds(names)), None
            while True:
                try:
                    n, at, h = runs.send(ok)
                except StopIteration:
                    break
                cell = h >> np.uint64(64 - bits)
                ok = (table[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 > 0
                mine = ok & (at < s.own)
                own, first, many = np.unique(h[mine], return_index=True, return_counts=True)
                place = at[mine][first]
                met.append((own, many))
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, own), len(seen) - 1)] != own
                    own, place = own[new], place[new]
                if not len(place):
                    continue
                key = s.lang[place].astype(np.int64) * parts + ((own >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                ids = s.v.ids[place[order][:, None] + np.arange(n)]
                end = np.cumsum((s.v.at[ids + 1] - s.v.at[ids]).sum(axis=1))
                text = s.v.joined(ids.ravel())
                text[end - 1] = 10  # no phrase holds a line end
                keys, count = np.unique(key, return_counts=True)
                at_end = end[np.cumsum(count) - 1]
                hashes, upto = own[order], np.cumsum(count)
                for k, a, b, i, j in zip(keys.tolist(), [0, *at_end[:-1].tolist()], at_end.tolist(), (upto - count).tolist(), upto.tolist()):
                    lines, of = held.setdefault((k % parts, names[k // parts]), (bytearray(), bytearray()))
                    lines.extend(text[a:b].tobytes())
                    of.extend(hashes[i:j].tobytes())
                size += len(text)
            fold()
            if len(seen) > REMEMBERED:
                yield counted()
                seen, often = seen[:0], often[:0]
            if size > AT_ONCE:
                yield rows()
                held, size = {}, 0
        yield rows()
        yield counted()
        of = [xxhash.xxh64_intdigest(x.encode()) % parts for x in words]
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(list(words), pa.string()), pa.nulls(len(of), pa.string()), pa.array(list(words.values()), pa.int64()), pa.nulls(len(of), pa.binary()), pa.nulls(len(of), pa.binary())], _CANDIDATE)

    return run


def _distinct(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(lang, phrase, n, a)``: every phrase of some parts that was met ``least`` times, once, with its words' number; without a phrase a language's sum of words."""
        now, found, words, keys, counts = None, {}, {}, [], []

        def rows() -> Iterator[pa.RecordBatch]:
            all_keys, place = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_inverse=True)
            total = np.zeros(len(all_keys), np.int64)
            np.add.at(total, place, np.concatenate([*counts, np.zeros(0, np.int64)]))
            for lang, (lines, own) in found.items():
                of = np.frombuffer(own, np.uint64)
                sums = total[np.searchsorted(all_keys, of)]
                enough = np.flatnonzero(sums >= least).tolist()
                told = lines.decode().split("\n")
                listed = sorted({(told[k], int(sums[k])) for k in enough})
                for k in range(0, len(listed), 1 << 16):
                    some = listed[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([p for p, _ in some], pa.string()), pa.array([p.count(" ") + 1 for p, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], ["lang", "phrase", "n", "a"])
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.nulls(len(words), pa.string()), pa.array(list(words.values()), pa.int64()), pa.nulls(len(words), pa.int64())], ["lang", "phrase", "n", "a"])

        for b in batches:
            for part, lang, phrases, n, of, many in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    yield from rows()
                    now, found, words, keys, counts = part, {}, {}, [], []
                if many is not None:
                    keys.append(np.frombuffer(of, np.uint64))
                    counts.append(np.frombuffer(many, np.int64))
                elif phrases is None:
                    words[lang] = words.get(lang, 0) + n
                else:
                    lines, own = found.setdefault(lang, (bytearray(), bytearray()))
                    lines.extend(phrases.encode())
                    own.extend(of)
        yield from rows()

    return run


class _Automata:
    """A group's phrases by language: a character for each word, an automaton over them, and where words' own counts go."""

    def __init__(self, group: bytes):
        rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(group)).read_all()
        self.size, self.by_lang, self.length = rows.num_rows, {}, np.zeros(rows.num_rows, np.int64)
        for k, (lang, phrase) in enumerate(zip(rows.column("lang").to_pylist(), rows.column("phrase").to_pylist())):
            code, auto, single = self.by_lang.setdefault(lang, ({}, ahocorasick.Automaton(ahocorasick.STORE_INTS), {}))
            words = phrase.encode().split(b" ")
            self.length[k] = len(words)
            for w in words:
                code.setdefault(w, _character(len(code)))
            if len(words) > 1:
                auto.add_word("".join(chr(code[w]) for w in words), k)
            else:
                single[code[words[0]]] = k
        for _, auto, _ in self.by_lang.values():
            auto.make_automaton()


def _character(k: int) -> int:
    """A character for word ``k``; zero is the guard, and surrogates are none."""
    return k + 1 if k + 1 < 0xD800 else k + 1 + 0x800


def _counted(sent, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(slot, sums)``: counts of a task by the phrases' places in the group, as rows of many."""
        auto: _Automata = resident("phrases", name, lambda: _Automata(sent.value))
        total = np.zeros(-(-auto.size // SLOT) * SLOT, np.int64)
        for names, s in _stretches(batches, STRETCH):
            listed = s.v.listed()
            for k in np.unique(s.lang).tolist():
                if names[k] not in auto.by_lang:
                    continue
                code, machine, single = auto.by_lang[names[k]]
                here = np.flatnonzero(s.lang == k)
                ids, number = np.unique(s.v.ids[here], return_inverse=True)
                coded = np.array([code.get(listed[w], 0) for w in ids.tolist()], np.uint32)
                text = coded[number]
                seen = np.bincount(text[here < s.own], minlength=1)
                known = np.array([single.get(c, -1) for c in np.flatnonzero(seen).tolist()], np.int64)
                total[known[known >= 0]] += seen[np.flatnonzero(seen)[known >= 0]]
                if not len(machine):
                    continue
                ends = np.flatnonzero(np.diff(s.piece[here])) + 1
                guarded = np.insert(text, ends, 0)
                place = np.insert(here, ends, -1)
                matches = machine.iter(guarded.astype("<u4").tobytes().decode("utf-32-le"))
                found = np.fromiter(chain.from_iterable(matches), np.int64).reshape(-1, 2)
                # a match counts where it begins; those that begin beyond belong to the next stretch
                begin = place[found[:, 0]] - auto.length[found[:, 1]] + 1
                total += np.bincount(found[begin < s.own, 1], minlength=len(total))
        rows = total.reshape(-1, SLOT)
        held = np.flatnonzero(rows.any(axis=1))
        values = pa.FixedSizeListArray.from_arrays(rows[held].ravel(), SLOT).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), values], ["slot", "sums"])

    return lean(run, keeps="phrases")


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n_words, a)``, every word and phrase that occurs ``least`` times or more, and ``(lang, n)``, all words.

    The texts are read twice, whatever the number of candidates.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    texts = _texts(docs, text_col, lang_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // 8).bit_length()))  # about four occurrences a cell
    sent = spark.sparkContext.broadcast(sketch(texts, least, bits))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    found = texts.mapInArrow(lean(_candidates(sent, bits, parts)), "part int, lang string, phrases string, words long, keys binary, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    found = scratch.save(found.mapInArrow(lean(_distinct(least)), "lang string, phrase string, n long, a long"))
    sent.unpersist()
    return found.where("phrase is not null").select("lang", "phrase", "a", F.col("n").alias("n_words")), found.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))


def recounted(texts: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """``(lang, phrase, a)`` of ``known(lang, phrase)``: matches of an automaton a language, one scan of the texts for each group of phrases."""
    spark = texts.sparkSession
    known = scratch.save(known.withColumn("id", F.monotonically_increasing_id()))
    n, single = known.agg(F.count(F.lit(1)), F.count_if(~F.contains("phrase", F.lit(" ")))).first()
    groups = -(-n // (GROUP if single <= CHARACTERS else SMALL_GROUP))
    dealt = known.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(max(1, groups))).cast("int"))
    parts = [known.select("id", F.lit(0).cast("long").alias("a")).limit(0)]
    for g in range(groups):
        own = dealt.where(F.col("group") == g).select("id", "lang", "phrase").toArrow()  # a group's size is bounded
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as out:
            out.write_table(own)
        sent = spark.sparkContext.broadcast(zstandard.compress(sink.getvalue().to_pybytes()))
        sums = texts.mapInArrow(_counted(sent, uuid.uuid4().hex), "slot int, sums array<long>")
        sums = scratch.save(sums).repartition("slot").mapInArrow(lean(slot_sums), "place int, n long").select("place", F.col("n").alias("a"))
        ids = spark.createDataFrame(pa.table({"place": pa.array(np.arange(own.num_rows, dtype=np.int32)), "id": own.column("id")}))
        parts.append(scratch.save(sums.join(ids, "place").select("id", "a")))
        sent.unpersist()
    return known.join(reduce(DataFrame.unionByName, parts), "id", "left").select("lang", "phrase", F.coalesce("a", F.lit(0)).alias("a"))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, idle: int = IDLE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases."""
    scratch = Scratch(docs.sparkSession, "phrases")
    known, words = counts(docs, least, text_col, lang_col)
    split = known.where(F.col("n_words") >= SHORTEST).withColumn("w", F.split("phrase", " "))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    # one word more is enough to look at: whatever holds a phrase holds it within such a one, which is as frequent
    within = split.where(F.col("n_words") > SHORTEST).select("lang", "a", F.explode(F.array_distinct(F.array(joined(F.lit(1), F.col("n_words") - 1), joined(F.lit(2), F.col("n_words") - 1)))).alias("phrase"))
    longer = scratch.save(within.groupBy("lang", "phrase").agg(F.max("a").alias("held")))
    stay = split.join(longer, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < idle * F.col("a"))).drop("held")
    stay = scratch.save(stay)

    cut = stay.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words").cast("int") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("n_words")).alias("right"))
    side = lambda c, n: known.select(F.col("lang"), F.col("phrase").alias(c), F.col("a").alias(n))
    both = scratch.save(scratch.save(cut.join(side("left", "l"), ["lang", "left"])).join(side("right", "r"), ["lang", "right"]))
    scored = both.join(words, "lang").select("lang", "phrase", "a", "n", F.struct(F.expr(SCORE).alias("score"), "k", "l", "r").alias("x"))
    best = scratch.save(scored.groupBy("lang", "phrase", "a", "n").agg(F.min("x").alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score", F.col("x.k").alias("k_cut")))

    # the first of each of many parts of a language, then the first of those
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    first = best.withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("k") <= top)
    ranked = scratch.save(first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top))
    # what is reported, ``top`` phrases a language whatever the corpus, is counted again as words
    split, k = F.split("phrase", " "), F.col("k_cut")
    row = lambda text, n: F.struct(text.alias("phrase"), F.col(n).alias("n"))
    side = lambda start, size, n: row(F.array_join(F.slice(split, start, size), " "), n)
    told = F.array(row(F.col("phrase"), "a"), side(F.lit(1), k, "l"), side(k + 1, F.size(split), "r"))
    told = scratch.save(ranked.select("lang", F.explode(told).alias("x")).select("lang", "x.*").distinct())
    exact = recounted(_texts(docs, text_col, lang_col), told.select("lang", "phrase").distinct(), scratch)
    if not told.join(exact, ["lang", "phrase"]).where("n <> a").isEmpty():
        raise ValueError("two phrases of a language share a 64-bit hash: the counts are not exact")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, size, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM w, (SELECT range AS size FROM range(1, 6)) s
), f AS (SELECT lang, phrase, size, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
s AS (SELECT *, string_split(phrase, ' ') AS x FROM f WHERE size >= 2),
inner_ AS (
  SELECT lang, array_to_string(x[1:size - 1], ' ') AS phrase, a FROM s WHERE size > 2
  UNION ALL SELECT lang, array_to_string(x[2:size], ' '), a FROM s WHERE size > 2
), stay AS (
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.a >= {IDLE} * s.a)
), cut AS (
  SELECT lang, phrase, a, x, size, unnest(range(1, size)) AS k FROM stay
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, t.n, (1000 * c.a * t.n) // (l.a * r.a) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * c.a * t.n) // (l.a * r.a), c.k) AS best
  FROM cut c JOIN total t USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.x[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.x[c.k + 1:c.size], ' ')
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM scored WHERE best = 1
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {TOP}
"""
