"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every document becomes a vector of statistics of its whole text.  Random
Fourier features approximate a Gaussian kernel over them; each partition adds
up its normal equations, the sums are solved for ridge scores on the driver
(a matrix of fixed size), and isotonic regression over a histogram of all
calibration rows turns scores into probabilities: between the middles of two
pooled blocks the score runs from one block's share to the next one's.

Learning rows are split by a hash of their id: one part fits the ridge, the
other chooses the kernel's width and fits the calibration, so both are judged
on rows that the ridge has not seen, and held-out rows have no say in anything.

Defined results: null and empty texts get the statistics of an empty text and
a score; very long texts are read whole; equal statistics tie; repeated rows
each get a row; labelled ids that occur twice count twice; a null doc_id is
scored, never learned from, and has a null ``held_out``; with no labels, or one
class only, the score is the smoothed share of label 1 (0.5 without labels); an
empty table gives an empty result; other columns are ignored, or kept by
``keep_good``, which judges every row by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, evict, free_memory, lean, parts, pieces, table

#: Random features, ridge weight, bins of the calibration's histogram, seed.
FEATURES, RIDGE, BINS, SEED = 256, 1e-3, 512, 7

_KIND = np.zeros(256, np.int64)  # 0 other
_KIND[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 1
_KIND[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 2
_KIND[np.frombuffer(b"0123456789", np.uint8)] = 3
_KIND[np.frombuffer(b" \t\r\x0b\x0c", np.uint8)] = 4
_KIND[10] = 5
_KIND[np.frombuffer(b".,", np.uint8)] = 6
_KIND[np.frombuffer(b"!?", np.uint8)] = 7
_KIND[np.frombuffer(b"|<>{}[]()=/\\_", np.uint8)] = 8
_KIND[np.frombuffer(b"#$%&*@^~+", np.uint8)] = 9
_KIND[np.frombuffer(b"'\"-:;", np.uint8)] = 10
_KIND[128:] = 11
N_STATS = 21
#: Widths of the kernel to choose from, in standard deviations of a statistic.
WIDTHS = tuple(w * N_STATS**0.5 for w in (0.75, 1.0, 1.5, 2.25))


def statistics(text: bytes | None) -> list[float]:
    """Shares of kinds of bytes, repetition and lengths of a whole text."""
    text = text or b""
    n = len(text)
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=12)
    words, lines = text.split(), text.split(b"\n")
    w, d = max(1, len(words)), max(1, len(lines))
    distinct = len(set(words))
    bare = {x.strip(b".,!?#$%&*|") for x in set(words)}
    return [
        *(kinds / max(1, n)).tolist(),
        distinct / w,
        len(set(lines)) / d,
        n / w / 10,
        np.log1p(len(words)) / 10,
        np.log1p(len(words) / d) / 5,
        (kinds[7] + kinds[8] + kinds[9]) / w,
        kinds[6] / w,
        len(bare) / max(1, distinct),
        float(np.log1p(distinct) / max(1.0, np.log1p(len(words)))),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            x = np.array([statistics(t) for t in b.column(1).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(x.ravel(), N_STATS).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), "doc_id long, x array<double>")


class Fourier:
    """cos(xW + b) over standardised statistics, for a Gaussian kernel of the given width."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, width: float, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    c = batch.column(batch.schema.get_field_index(name))
    return c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def normal_equations(rows: DataFrame, phi: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Sums of phi'phi and phi'y, added up within partitions and then by rows of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                f = phi(_matrix(b, "x"))
                y = b.column(b.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
                part = np.hstack([f.T @ f, (f.T @ y)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            k, m = total.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k, dtype=np.int32)), pa.FixedSizeListArray.from_arrays(total.ravel(), m).cast(pa.list_(pa.float64()))], ["i", "v"]
            )

    def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for i, v in zip(b.column(0).to_pylist(), _matrix(b, "v")):
                sums[i] = sums[i] + v if i in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["i", "v"])

    sums = rows.select("x", "y").mapInArrow(lean(run), "i int, v array<double>")
    # each of the matrix's rows is summed by one task
    got = sums.repartition("i").mapInArrow(summed, "i int, v array<double>").collect()  # one matrix of fixed size
    full = np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])
    return full[:, :-1], full[:, -1]


def isotonic(total: np.ndarray, ones: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of ``at``: the mean place and the smoothed share of ones of each block.

    Places and shares both rise.
    """
    prior = (ones.sum() + 0.5) / (total.sum() + 1)  # half a row of it in each bin
    blocks: list[list[float]] = []
    for n, k, x in zip((total + 0.5).tolist(), (ones + 0.5 * prior).tolist(), at.tolist()):
        blocks.append([n, k, n * x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    n, k, x = np.array(blocks, float).reshape(-1, 3).T
    return x / n, k / n


class Model:
    """Statistics to a score from 0 to 1."""

    def __init__(self, constant: float):
        self.constant, self.phi = constant, None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated share of label 1; beyond the outermost blocks theirs."""
        if self.phi is None or not len(x):
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), self.at, self.share), 0, 1)


def squared_errors(rows: DataFrame, models: list[tuple[Fourier, np.ndarray]]) -> list[float]:
    """Of each ridge the sum of squared differences between its scores and the labels, added up within partitions first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(models))
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b, "x"), b.column(b.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
                total += [float(((phi(x) @ beta - y) ** 2).sum()) for phi, beta in models]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(total)], ["k", "e"])

    got = rows.select("x", "y").mapInArrow(lean(run), "k int, e double").groupBy("k").agg(F.sum("e").alias("e")).collect()  # a row a model
    return [r["e"] for r in sorted(got, key=lambda r: r["k"])]


def learn(rows: DataFrame) -> Model:
    """``rows(x, y, part)``: part 0 fits the ridge, part 1 the calibration."""
    stats = rows.select(
        F.count(F.lit(1)), F.sum("y"), F.count_if(F.col("part") == 0), F.sum(F.when(F.col("part") == 0, F.col("y"))),
        *[f(F.col("x")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)],
    ).first()
    n, ones, n0, ones0 = stats[0], stats[1] or 0.0, stats[2], stats[3] or 0.0
    model = Model((ones + 1) / (n + 2))
    if not 0 < ones0 < n0:
        return model
    mean, std = np.array(stats[4::2], float), np.array(stats[5::2], float)
    fit = rows.where("part = 1") if n > n0 else rows
    tried = []
    for width in WIDTHS:
        phi = Fourier(mean, np.where(std > 1e-9, std, 1.0), width=width)
        a, b = normal_equations(rows.where("part = 0"), phi)
        tried.append((phi, np.linalg.solve(a + RIDGE * n0 * np.eye(len(a)), b)))
    model.phi, model.beta = tried[int(np.argmin(squared_errors(fit, tried)))]
    sent = model

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = np.clip((sent.raw(_matrix(b, "x")) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k), b.column(b.schema.get_field_index("y"))], ["k", "y"])

    hist = fit.select("x", "y").mapInArrow(bins, "k int, y double").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).orderBy("k").collect()
    k, n, y = (np.array([r[i] for r in hist], float) for i in range(3))
    model.at, model.share = isotonic(n, y, (k + 0.5) / BINS * 2 - 0.5)
    return model


def remainder(id_col: str, m: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labels whose crc32 remainder by 3 is not 1."""
    y = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    y = y.where(remainder("doc_id", 3) != 1)
    rows = stats.join(y, "doc_id").select("x", "y", F.when(remainder("doc_id", 3) == 0, 0).otherwise(1).alias("part"))
    scratch = Scratch(spark, "quality")
    return learn(scratch.save(rows))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    spark = docs.sparkSession
    stats = Scratch(spark, "quality").save(with_statistics(docs, id_col, text_col))
    model = fit(spark, stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b, "x")) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = stats.select("doc_id", "x").mapInArrow(lean(run), "doc_id long, score double")
    return scored.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose text the classifier does not reject; every column is kept.

    No text is shuffled: the classifier learns from statistics, and each row is
    then judged where it is, by its own text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    stats = scratch.save(with_statistics(docs, id_col, text_col))
    model = fit(spark, stats, labels)
    scratch.drop(stats)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        evict()
        for whole in columns:
            good: list[np.ndarray] = []
            for c in parts(whole):
                x = np.array([statistics(t) for t in c.cast(pa.binary()).to_pylist()], np.float64).reshape(-1, N_STATS)
                good.append(model.score(x) >= 0.5)
            yield pa.array(np.concatenate(good) if good else np.zeros(0, bool))
        free_memory()

    return docs.where(F.arrow_udf(run, "boolean")(F.col(text_col).cast("string")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
