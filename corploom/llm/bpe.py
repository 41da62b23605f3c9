"""BPE encoding and decoding for vocabularies with word ends.

Speculate and verify.  For each distinct word a greedy longest match proposes
tokens.  A proposal is right if every token is what BPE makes of its own
characters and if, at every adjacent pair, BPE makes the two tokens of their
joined characters too; all pairs of a batch of words are checked at once in
numpy against a table of pairs judged so far.  Only failing words are merged
step by step.

The pair test is exact: merge order decides a boundary by the merges within
reach of it, and a boundary that survives in the joined text of its two tokens
survives in any text in which both tokens stand next to each other, since a
merge across it could only use a piece that is a suffix of the left token and
a prefix of the right one.

Defined results: null and empty texts have no tokens and decode to the empty
string; strings of special tokens in a text become those tokens; very long
texts are encoded whole, and a very long word is merged through a heap, in time
that grows with its length but for a logarithm; merges of one rank are made
from the left; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, pieces, resident, table

#: Characters on which all libraries agree about case, normal form, classes and white space.
ODD = r"[^\x00-\x1b\x20-\x7f\xa1-\xac\xae-\u012f\u0134-\u0148\u014a-\u017e]"
#: Bytes of words and of pieces between white space, and pairs, that a worker remembers in each of two generations.
MEMORY, PAIRS = 80 << 20, 600_000
#: Bytes that an entry takes besides its strings; pieces of a word that are merged through a heap.
ENTRY, HEAP_FROM = 400, 128
NONE = 1 << 60
#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 21


class WordBpe:
    """A tokenizer file of type BPE with ``end_of_word_suffix``."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        data = json.loads(spec)
        model = data["model"]
        self.lib = Tokenizer.from_str(spec)
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {self.vocab[x] << 32 | self.vocab[y]: k for k, (x, y) in enumerate(merges)}
        self.made = [self.vocab[x + y] for x, y in merges]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.reach: dict[str, int] = {}  # longest token that begins with these three characters
        for t in self.vocab:
            if not t.endswith(self.end):
                self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))
        self.last = {t[: -len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end) and t != self.end}
        self.longest = max(map(len, self.last))
        self.pattern = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.odd = re.compile(ODD)
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the usual printable stand-ins for bytes
        rest = [b for b in range(256) if b not in shown]
        self.stand_in = {b: 256 + k for k, b in enumerate(rest)}
        self.sound: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of words, pieces and pairs."""
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.pieces: dict[str, tuple[int, str, str]] = {}
        self.old_known, self.old_pieces = self.known, self.pieces
        self.held = 0

    def age(self) -> None:
        """Start a new generation; what it asks for again comes over from the last one, the rest is forgotten with the next."""
        self.old_known, self.old_pieces = self.known, self.pieces
        self.known, self.pieces, self.held = {}, {}, 0

    def units(self, shown: str) -> list[int]:
        """Ids of single characters, the word end on the last; one without a token is left out, as in the library."""
        vocab = self.vocab
        out = [vocab.get(c, -1) for c in shown[:-1]]
        out.append(self.last.get(shown[-1], -1))
        return [x for x in out if x >= 0] if -1 in out else out

    def token_units(self, token: int) -> list[int]:
        name = self.names[token]
        if name.endswith(self.end) and name != self.end:
            return self.units(name[: -len(self.end)])
        return [self.vocab[c] for c in name]

    def merge(self, parts: list[int]) -> list[int]:
        """Exact merging: always the first pair of least rank."""
        if len(parts) >= HEAP_FROM:
            return self.merge_long(parts)
        get = self.rank.get
        ranks = [get(x << 32 | y, NONE) for x, y in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            k = ranks.index(low)
            new = parts[k] = self.made[low]
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] << 32 | new, NONE)
            if k < len(ranks):
                ranks[k] = get(new << 32 | parts[k + 1], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs and links to the neighbours that are left."""
        get, made, n = self.rank.get, self.made, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k in range(n - 1) if (r := get(parts[k] << 32 | parts[k + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            m = right[k]
            if parts[k] < 0 or m >= n or get(parts[k] << 32 | parts[m], NONE) != rank:
                continue  # one of the two has been merged since
            parts[k], parts[m] = made[rank], -1
            right[k] = m = right[m]
            if m < n:
                left[m] = k
                if (r := get(parts[k] << 32 | parts[m], NONE)) != NONE:
                    heapq.heappush(heap, (r, k))
            if (b := left[k]) >= 0 and (r := get(parts[b] << 32 | parts[k], NONE)) != NONE:
                heapq.heappush(heap, (r, b))
        return [x for x in parts if x >= 0]

    def greedy(self, word: str) -> list[int] | None:
        """Longest match from the left over stand-in characters; None if a character has no token."""
        out, k, n = [], 0, len(word)
        vocab, reach, last, longest = self.vocab, self.reach, self.last, self.longest
        while True:
            if n - k <= longest and (t := last.get(word[k:])) is not None:
                out.append(t)
                return out
            for m in range(min(reach.get(word[k : k + 3], 2), n - k - 1), 0, -1):
                if (t := vocab.get(word[k : k + m])) is not None:
                    out.append(t)
                    k += m
                    break
            else:
                return None

    def is_sound(self, token: int) -> bool:
        ok = self.sound.get(token)
        if ok is None:
            ok = self.sound[token] = self.merge(self.token_units(token)) == [token]
        return ok

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each adjacent pair of ids: does BPE keep the two apart and whole?"""
        found, at = np.unique(left << 32 | right, return_inverse=True)
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        pairs, good = self.pairs, []
        for x in found.tolist():
            ok = pairs.get(x)
            if ok is None:
                a, b = x >> 32, x & 0xFFFFFFFF
                ok = x not in self.rank and self.is_sound(a) and self.is_sound(b) and self.merge(self.token_units(a) + self.token_units(b)) == [a, b]
                pairs[x] = ok
            good.append(ok)
        return np.array(good, bool)[at]

    def learn(self, words: list[str]) -> None:
        """Tokens of words not yet known, all at once."""
        shown = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.stand_in) for w in words]
        ids = [self.greedy(s) or [] for s in shown]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(ids)), n)
        same = owner[1:] == owner[:-1]
        bad = n == 0
        bad[owner[1:][same][~self.compatible(flat[:-1][same], flat[1:][same])]] = True
        names = self.names
        for w, s, g, wrong in zip(words, shown, ids, bad.tolist()):
            if wrong or (len(g) == 1 and not self.is_sound(g[0])):
                g = self.merge(self.units(s))
            self.known[w] = got = (len(g), " ".join(map(str, g)), " ".join([names[x] for x in g]))
            self.held += ENTRY + len(w) + len(got[1]) + len(got[2])

    @staticmethod
    def joined(got: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        got = [g for g in got if g[0]]
        return sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])

    def cut(self, text: str) -> list[str]:
        """Pieces between white space, as the library's normalizer leaves them."""
        if self.odd.search(text):
            text = self.lib.normalizer.normalize_str(text)
            if self.odd.search(text):
                return text.split(" ")
            return text.split()
        return text.lower().split()

    def split(self, piece: str) -> list[str]:
        """Words of a piece, as the library's pre-tokenizer cuts it."""
        if piece.isascii() and piece.isalpha():
            return [piece]
        if self.odd.search(piece):
            return [piece[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(piece)]
        return self.pattern.findall(piece)

    def bring(self, asked: Iterable[str], to: dict, old: dict) -> None:
        """Take over from the last generation what is asked for."""
        for x in asked:
            if (got := old.get(x)) is not None and x not in to:
                to[x] = got
                self.held += ENTRY + len(x) + len(got[1]) + len(got[2])

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids joined by spaces, decoded text."""
        if self.held > MEMORY:
            self.age()
        known, pieces = self.known, self.pieces
        cut: list[list] = []  # lists of pieces, and ids of special tokens
        for t in texts:
            parts: list = []
            at = 0
            for m in self.specials.finditer(t) if self.specials and t else ():
                parts += [self.cut(t[at : m.start()]), self.special[m[0]]]
                at = m.end()
            parts.append(self.cut(t[at:] if t else ""))
            cut.append(parts)
        fresh = set()
        for parts in cut:
            for p in parts:
                if not isinstance(p, int):
                    fresh.update(p)
        fresh = [p for p in fresh if p not in pieces]
        self.bring(fresh, pieces, self.old_pieces)
        new = [(p, self.split(p)) for p in fresh if p not in pieces]
        words = {w for _, ws in new for w in ws if w not in known}
        self.bring(words, known, self.old_known)
        words = [w for w in words if w not in known]
        if words:
            self.learn(words)
        for p, ws in new:
            pieces[p] = got = known[ws[0]] if len(ws) == 1 else self.joined([known[w] for w in ws])
            self.held += ENTRY // 4 + (0 if len(ws) == 1 else ENTRY + len(p) + len(got[1]) + len(got[2]))
        out = []
        for parts in cut:
            got: list[tuple[int, str, str]] = []
            for p in parts:
                got += [(1, str(p), self.names[p])] if isinstance(p, int) else map(pieces.__getitem__, p)
            out.append(self.joined(got))
        return out


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``; with ``texts`` also ``ids`` and ``decoded``.

    ``spec`` is the tokenizer file's content, read on the driver (2 MB, fixed
    by the vocabulary) and sent once to each executor.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(sent.value.encode()).digest()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in pieces(batches, 1, AT_ONCE):
            bpe = resident("bpe", key, lambda: WordBpe(sent.value))
            got = bpe.encode(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([sha(g[1]) for g in got], pa.string()), pa.array([sha(g[2]) for g in got], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                cols += [pa.array([list(map(int, g[1].split())) for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts)


def word_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), read_spec(word_bpe_path()))
