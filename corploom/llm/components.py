"""Connected components with DataFrame operations only.

Alternating large-star and small-star passes over an edge table.  Each pass
is a partially aggregated minimum and an equi join, so a hub's neighbours are
never gathered in one row or task; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` of any one orderable type -> ``(node, component)``.

    ``component`` is the least node reachable.  Rows with a null end are no
    edges; loops and repeats do no harm; no edges give an empty table.  Only
    nodes with an edge to another node are listed.
    """
    now = scratch.save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every greater neighbour of u hangs on the least one
        big = scratch.save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u's lesser neighbours and u itself hang on the least one
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(big, now)
        then, mark, now = mark, _mark(nxt), nxt
        if mark == then:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
