"""The corpus pipeline: documents through the stages in order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of documents.

Defined results: null and empty texts go through like any other, as far as the
classifier keeps them; very long texts are read whole; rows are judged by their
own text, so rows of one doc_id may fare differently, and of rows alike in both
one stays; a null doc_id comes after all others where one of a group is chosen;
without labels, or with one class only, the classifier keeps all or nothing by
the smoothed share of label 1; an empty table gives an empty result; other
columns, whatever their names, are kept by all stages but the last.

A stage's scratch tables are deleted when the next stage begins, since its
result has been written by then; tables made outside the pipeline are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corploom.llm import bpe, decontamination, quality, simhash, substring
from corploom.llm.common import Scratch, release, scope, table

SCOPE = "pipeline"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    release(spark, SCOPE)
    with scope(SCOPE):
        return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    release(spark, SCOPE)
    with scope(SCOPE):
        return simhash.keep_first(docs)


def passages_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    release(spark, SCOPE)
    with scope(SCOPE):
        return substring.remove(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    release(spark, SCOPE)
    with scope(SCOPE):
        return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and decoded text, of each document left."""
    release(spark, SCOPE)
    with scope(SCOPE):
        return bpe.encode(docs, bpe.read_spec(bpe.word_bpe_path()))


STAGES = [
    ("quality", good_quality),
    ("simhash", near_deduplicated),
    ("substring", passages_removed),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: A classifier, edit distances and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of the tables between them the last one stays until ``release``, since the result reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    tables = Scratch(spark, "stage")
    for _, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
