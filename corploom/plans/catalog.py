"""Usage counters and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_text(n: Column) -> Column:
    """1234 as 1.2K, 1234567 as 1.23M; cut, not rounded."""
    million, thousand = F.floor(n / 10000) / 100, F.floor(n / 100) / 10
    return F.when(n >= 1_000_000, F.concat(million.cast("string"), F.lit("M"))).when(n >= 1000, F.concat(thousand.cast("string"), F.lit("K"))).otherwise(n.cast("string"))


#: The sums that a run's usage is made of.
USAGE = ("requests", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def merged_usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, the five sums, ``total`` of all tokens and ``shown``; counters merge by adding, so in any order and grouping."""
    sums = rows.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in USAGE])
    total = sum((F.col(c) for c in USAGE[1:]), F.lit(0))
    return sums.withColumn("total", total.cast("long")).withColumn("shown", usage_text(F.col("total")))
