"""Toxicity classifier on bags of subwords.

A word is the mean of the vectors of its character n-grams and of itself, all
hashed into one table; a text is the mean of its words; a linear softmax reads
the text.  Table and softmax are trained jointly in numpy, so a misspelling
never seen shares most of its n-gram vectors with the word it stands for.

Learning uses a bounded sample of labelled rows (``SAMPLE`` rows and
``SAMPLE_BYTES`` of text, parameters): the rows of least hash, half of them of
each class where there are enough, those whose text would go beyond the bytes
left out.  Every document is scored over its whole text.

Because the softmax is linear in the mean, a word adds a fixed number to a
text's margin; workers keep those numbers for words they have met.

Defined results: null and empty texts are scored by the bias alone; very long
texts are scored whole; texts of the same words tie; repeated rows each get a
row; a null doc_id is scored, never learned from, and has a null ``held_out``;
of several texts under one labelled doc_id the one of least hash is learned
from; a doc_id labelled both ways counts both ways; without labels, or with one class only, the score is the smoothed share of label 1
(0.5 without labels); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, pieces, table, text_key
from .quality import remainder

#: Labelled rows to learn from and bytes of their texts, slots of the table, width of a vector, epochs, damping, seed.
SAMPLE, SAMPLE_BYTES, SLOTS, WIDTH, EPOCHS, DAMPING, SEED = 4000, 24 << 20, 1 << 18, 4, 80, 3.0, 11
#: Lengths of n-grams taken everywhere in <word>, and at its start only.
GRAMS, STARTS = (4, 5, 6), (3, 7, 8, 9, 10)
#: Words of a share p of the sample weigh COMMON / (COMMON + p) in the mean.
COMMON = 1e-3
#: Words that a worker remembers, and bytes of text that it cuts into words at once.
MEMORY, AT_ONCE = 200_000, 1 << 19

_WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def slots(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all words, and the number of each word's."""
    marked = [f"<{w}>" for w in ws]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), size)
    start = np.cumsum(size) - size
    at = np.arange(len(code)) - start[word]
    left = size[word] - at
    got, owner = [], []
    h = code.copy()
    for n in range(2, min(max(GRAMS + STARTS), len(code)) + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in GRAMS or n in STARTS:
            ok = left[: len(h)] >= n
            if n in STARTS:
                ok &= at[: len(h)] == 0
            x = h[ok]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            got.append(((x ^ (x >> np.uint64(32))) % np.uint64(SLOTS)).astype(np.int32))
            owner.append(word[: len(h)][ok])
    if not got:
        return np.zeros(0, np.int32), np.zeros(len(ws), np.int64)
    owner = np.concatenate(owner)
    return np.concatenate(got)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(ws))


def _means(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean of each run of ``n`` values; 0 for an empty run."""
    total = np.bincount(np.repeat(np.arange(len(n)), n), values, len(n))
    return total / np.maximum(1, n)


class Model:
    """``vectors`` (slots x width), ``out`` (width x 2), ``bias`` (2) and ``weight`` of common words."""

    def __init__(self, constant: float = 0.5):
        self.constant = constant
        self.vectors: np.ndarray | None = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.constant)
        if not hasattr(self, "margin"):
            # what each slot adds to the margin of class 1 over class 0
            self.slot_margin = self.vectors @ (self.out[:, 1] - self.out[:, 0])
            self.margin: dict[str, float] = {}
        if len(self.margin) > MEMORY:
            self.margin.clear()
        known, z = self.margin, np.zeros(len(texts))
        cut = [words(t) for t in texts]
        new = list({w for ws in cut for w in ws if w not in known})
        if new:
            flat, n = slots(new)
            weight = self.weight
            known.update((w, m * weight.get(w, 1.0)) for w, m in zip(new, _means(self.slot_margin[flat], n).tolist()))
        for k, ws in enumerate(cut):
            if ws:
                z[k] = sum(map(known.__getitem__, ws)) / len(ws)
        return 1 / (1 + np.exp(-np.clip(z + self.bias[1] - self.bias[0], -30, 30)))

    def forget(self) -> None:
        """Drop the margins of words met so far."""
        for k in ("margin", "slot_margin"):
            self.__dict__.pop(k, None)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("margin", "slot_margin")}


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train table and softmax jointly on class-balanced cross entropy.

    Each epoch moves the vectors along the gradient, scaled for each slot by
    its damped second moment, as far as Newton's step along that line goes, and
    the softmax by a short scaled gradient step.
    """
    y = np.array(labels, np.int64)
    model = Model((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return model
    index: dict[str, int] = {}
    cols, rows, share = [], [], []
    for k, t in enumerate(texts):
        ids, n = np.unique(np.array([index.setdefault(w, len(index)) for w in words(t)], np.int64), return_counts=True)
        cols.append(ids), rows.append(np.full(len(ids), k)), share.append(n / max(1, n.sum()))
    doc, word, share = np.concatenate(rows), np.concatenate(cols), np.concatenate(share)
    lengths = np.array([max(1, len(words(t))) for t in texts])
    often = np.bincount(word, share * lengths[doc], len(index)) / lengths.sum()
    weight = COMMON / (COMMON + often)
    x = share * weight[word]
    flat, n = slots(list(index))
    per = np.repeat(1 / np.maximum(1, n), n)  # a slot's part in its word
    owner = np.repeat(np.arange(len(index)), n)

    down = lambda v: np.bincount(doc, x * np.bincount(owner, v[flat] * per, len(index))[word], len(y))  # noqa: E731  slots to texts
    up = lambda g: np.bincount(flat, (np.bincount(word, g[doc] * x, len(index))[owner]) * per, SLOTS)  # noqa: E731  texts to slots

    balance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
    second = np.bincount(flat, (np.bincount(word, x * x, len(index))[owner]) * per * per, SLOTS) / len(y) + (up(np.ones(len(y))) / len(y)) ** 2
    scale = 1 / (second + DAMPING * second[second > 0].mean())
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1e-3, (WIDTH, SLOTS))
    out, bias = rng.choice([-0.5, 0.5], (WIDTH, 1)) * np.array([[-1.0, 1.0]]), np.zeros(2)
    for _ in range(epochs):
        text = np.stack([down(v) for v in vectors])
        z = text.T @ out + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        r = p.copy()
        r[np.arange(len(y)), y] -= 1
        r *= balance[:, None]
        g = up(r[:, 1])  # two classes: the other class's gradient is its negative
        move = g * scale
        lead = out[:, 1] - out[:, 0]
        step = down(move) * (lead @ lead)
        curve = (balance * p[:, 0] * p[:, 1] * step * step).sum() + 1e-12
        far = (g @ move) * (lead @ lead) / curve
        grad_out = text @ r
        vectors -= far * lead[:, None] * move[None, :]
        out -= 0.05 * grad_out / (np.sqrt((text * text).mean(axis=1, keepdims=True)) + 1e-6)
        bias -= 0.5 * r.sum(axis=0)
    model.vectors, model.out, model.bias = vectors.T.astype(np.float32), out, bias
    model.weight = {w: float(weight[k]) for w, k in index.items() if weight[k] < 0.99}  # at most 1 / (COMMON / 99) words
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model:
    """Fit on the labels whose crc32 remainder by 5 is not 0."""
    y = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    y = y.where(remainder("doc_id", 5) != 0).distinct()
    picked = [
        y.where(F.col("y") == c).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(sample // 2)  # a bounded sample, the same each run
        for c in (0, 1)
    ]
    scratch = Scratch(docs.sparkSession, "toxicity")
    ids = scratch.save(picked[0].unionByName(picked[1]))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("h"))
    # sizes first, a row for each label picked; then the texts within the bound
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sized = own.select("doc_id", "h", size.alias("n")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("h", "n")).alias("r"))
    left, chosen = most, []
    for r in sized.select("doc_id", "y", "r.h", "r.n").orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id", "y").collect():  # at most `sample` rows
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["doc_id"], r["y"], r["h"]))
    few = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int, h long")
    rows = own.join(F.broadcast(few), ["doc_id", "h"]).dropDuplicates(["doc_id", "y"]).orderBy("doc_id", "y").select("text", "y").toArrow()
    return train(rows.column("text").to_pylist(), rows.column("y").to_pylist())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(src, labels, sample, most))  # a table of fixed size, 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        try:
            for b in pieces(batches, 1, AT_ONCE):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])
        finally:
            model.forget()

    return src.mapInArrow(lean(run), "doc_id long, score double").select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
