"""Scratch tables in the shared folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KEPT: dict[tuple[str, str], list[str]] = {}
_SCOPE: ContextVar[str] = ContextVar("corploom_scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Only in one JVM (unit
    tests) may that be unset; then a folder of our own stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corploom-")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Scratch tables made inside belong to ``name``, so that ``release`` can delete them and no others."""
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


class Scratch:
    """Parquet tables that cut lineage and outlive lost executors.

    ``save`` writes a table and reads it back; ``drop`` removes one early.
    Tables that a lazy result still reads stay until ``release``.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        self.kept = _KEPT.setdefault((spark.sparkContext.applicationId, _SCOPE.get()), [])
        self.tables: list[tuple[DataFrame, str]] = []

    def path(self) -> str:
        """A new place in the shared folder, deleted by ``release``."""
        path = f"{shared_dir(self.spark)}/corploom-{self.tag}-{uuid.uuid4().hex}"
        self.kept.append(path)
        return path

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            for k, (own, path) in enumerate(self.tables):
                if own is t:
                    _delete(self.spark, path)
                    del self.tables[k]
                    if path in self.kept:
                        self.kept.remove(path)
                    break


def release(spark: SparkSession, name: str | None = None) -> None:
    """Delete the scratch tables of scope ``name`` that are still there; without a name, all of this application.

    Call it only when results made so far (in that scope) have been written or collected.
    """
    app = spark.sparkContext.applicationId
    for own in [k for k in _KEPT if k[0] == app and name in (None, k[1])]:
        paths = _KEPT[own]
        while paths:
            _delete(spark, paths.pop())


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that have been written and dropped.

    Spark deletes them once the driver's garbage collector has found their
    plans unused, which on a large heap may be long after.  It holds on to the
    plan that ran last, so another one runs here.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()
