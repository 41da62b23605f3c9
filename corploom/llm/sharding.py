"""Byte-limited shards by extendible hashing, in DataFrame operations.

The directory is indexed by the leading bits of a hash of the key.  A bucket
over the byte limit, and no other, splits on the next bit, until every shard
fits.  Bucket totals are partially aggregated sums, so only ``(prefix, bytes)``
rows are shuffled to build the directory, never texts.

Rows of one key share all their bits.  Where the rows of one key alone exceed
the limit (repeated rows of a hot key), a further hash of the row's content and
of its number in its task spreads them, so they split like others.  A single
row above the limit has a shard to itself, the only shard that may exceed it.

Defined results: null and empty texts count 0 bytes; very long texts are
measured whole; a null key hashes like the empty string; rows of one key share
a shard unless the key is hot; an empty table has no shards; other columns are
ignored by ``assign`` and kept by ``write_shards``, whose folders are named by
``shard``, with underscores before it if ``docs`` has such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table

#: Bytes of UTF-8 text in a shard at most.
LIMIT = 1 << 20
#: Bits of a hash, and bits that a round may split on.
BITS, STEP = 60, 12


def _hash(key: Column) -> Column:
    digits = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digits, 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: str, depth: Column | str | int) -> Column:
    return F.expr(f"shiftright({bits}, {BITS} - {depth})")


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, shard, depth, shard_bytes)`` for every row.

    ``shard`` is the bucket's prefix of ``depth`` bits, written in 0 and 1.
    """
    # written once, so that the row numbers stay as they are if a task runs again
    scratch = Scratch(docs.sparkSession, "sharding")
    return _place(scratch.save(_rows(docs, F.monotonically_increasing_id(), id_col, text_col)), limit, scratch).drop("n")


def _rows(docs: DataFrame, number: Column, id_col: str, text_col: str) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("n_bytes"), _hash(F.col(id_col)).alias("bits"),
        F.xxhash64(F.col(text_col).cast("string")).alias("h"), number.alias("n"),
    )


def _place(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """``assign`` of ``_rows`` whose numbers ``n`` stay as they are; ``n`` is kept."""
    many = rows.groupBy("bits").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("c")).where((F.col("b") > limit) & (F.col("c") > 1))
    hot = scratch.save(many.select("bits", F.lit(True).alias("hot")))
    keyed = rows.drop("h")
    if not hot.isEmpty():
        spread = _hash(F.concat_ws(":", "bits", "h", "n"))
        keyed = scratch.save(rows.join(hot, "bits", "left").select("n", "doc_id", "n_bytes", F.when(F.col("hot"), spread).otherwise(F.col("bits")).alias("bits")))

    out: list[DataFrame] = []
    top, waiting = 0, keyed
    while top < BITS:
        depth = top + STEP
        slots = waiting.groupBy(_prefix("bits", depth).alias("slot")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("c"))
        slots = scratch.save(slots)
        # each slot under its prefix at every depth of this round, with that prefix's total
        under = slots.withColumn("depth", F.explode(F.sequence(F.lit(top if top == 0 else top + 1), F.lit(depth)))).withColumn(
            "prefix", F.expr(f"shiftright(slot, {depth} - depth)")
        )
        total = under.groupBy("prefix", "depth").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
        fit = total.where((F.col("b") <= limit) | (F.col("c") == 1) | (F.col("depth") == BITS)).select("prefix", "depth", "b")
        # the bucket of a slot is the shortest prefix that fits; the directory has no more slots than hashes seen
        bucket = under.select("slot", "prefix", "depth").join(fit, ["prefix", "depth"]).groupBy("slot").agg(F.min(F.struct("depth", "prefix", "b")).alias("x"))
        directory = scratch.save(bucket)
        met = waiting.withColumn("slot", _prefix("bits", depth))
        out.append(met.join(directory, "slot").select(
            "n", "doc_id", "n_bytes", F.expr("if(x.depth = 0, '', lpad(bin(x.prefix), x.depth, '0'))").alias("shard"), "x.depth", F.col("x.b").alias("shard_bytes")
        ))
        if slots.join(directory, "slot", "left_anti").isEmpty():
            break
        waiting = scratch.save(met.join(directory, "slot", "left_anti").select("n", "doc_id", "n_bytes", "bits"))
        top = depth
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` in one folder for each shard; each row goes to the shard that its own number was assigned."""
    scratch = Scratch(docs.sparkSession, "sharding")
    row, shard, n = fresh(docs, "row", "shard", "n")
    numbered = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()))
    place = _place(scratch.save(_rows(numbered, F.col(row), id_col, text_col)), limit, scratch)
    place = place.select(F.col("n").alias(n), F.col("shard").alias(shard))
    put = numbered.join(place, numbered[row] == place[n]).drop(row, n)
    put.repartition(shard).write.partitionBy(shard).option("compression", "zstd").parquet(path)
    scratch.drop(numbered)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH r AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS bits
  FROM documents
), t AS (
  SELECT d.d, r.bits >> ({BITS} - d.d) AS p, sum(n_bytes) AS b, count(*) AS c
  FROM r, (SELECT CAST(range AS INTEGER) AS d FROM range(0, 41)) d GROUP BY 1, 2
), m AS (
  SELECT r.doc_id, r.n_bytes, t.d, t.p, t.b, row_number() OVER (PARTITION BY r.doc_id ORDER BY t.d) AS k
  FROM r JOIN t ON t.p = r.bits >> ({BITS} - t.d) WHERE t.b <= {LIMIT} OR t.c = 1
)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d, '0') END AS shard, d AS depth,
       CAST(b AS BIGINT) AS shard_bytes
FROM m WHERE k = 1
"""
