"""Mixing sources to target weights by nested thresholds of a hash.

Sources share the words of the whole corpus by their weights; a target stops at
``MOST`` times its source's words, and what is above is shared again among the
others.  A source is taken whole as often as fits; for the rest every row has a
hash of its id and text, words are summed by source and the hash's leading bits,
and of the bucket in which the running sum passes the budget, and of no other,
the next bits are looked at, until that bucket is one row.  Rows below the
threshold are taken once more, so nothing is sorted and every row is judged
where it is.  The last row is taken if that brings the sum nearer to the target,
so a source misses its target by half a document at most.

Defined results: null and empty texts have size 0 and take none; very long
texts count whole; a null source is a source, the last one; a null id hashes as
the empty string; repeated rows tie, and as many of them are taken as the budget
holds, it makes no difference which; an empty table gives an empty result; other
columns are ignored by ``mix`` and kept by ``draw``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, table
from .words import numbered

#: Weights of the sources in code-point order, repeating; times that a document is taken at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of the hash, of a row's number, and of a histogram's buckets.
BITS, NUMBER_BITS, STEP = 60, 64, 12


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)``, one row for each source, with ``weight`` and ``target``."""
    by_name = [F.col("source").asc_nulls_last()]
    ranked = numbered(sizes, by_name, "place", scratch)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    weight = F.element_at(F.lit(list(weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    now = scratch.save(ranked.select("source", "source_size", weight.cast("long").alias("weight"), F.lit(False).alias("full")))
    whole = now.agg(F.sum(exact("source_size"))).first()[0] or 0
    while True:
        held = now.agg(F.sum(F.when(F.col("full"), exact("source_size"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()  # one row
        rest, shared = whole - most * (held[0] or 0), held[1] or 0
        share = F.col("weight").cast("decimal(4,0)") * F.lit(int(rest)).cast("decimal(24,0)")
        above = ~F.col("full") & (share > F.lit(most).cast("decimal(4,0)") * F.col("source_size").cast("decimal(16,0)") * F.lit(int(shared)).cast("decimal(12,0)"))
        if now.where(above).isEmpty():
            break
        now = scratch.save(now.withColumn("full", F.col("full") | above))
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(share.cast("double") / F.lit(float(shared or 1)))
    return now.select("source", "source_size", "weight", target.alias("target"))


def _digit(level: int):
    """Bits of the hash, or after its end of the row's number, that a round looks at."""
    rounds = BITS // STEP
    name, shift = ("h", BITS - STEP * (level + 1)) if level < rounds else ("row", max(0, NUMBER_BITS - STEP * (level - rounds + 1)))
    return F.expr(f"cast(shiftrightunsigned({name}, {shift}) & {(1 << STEP) - 1} as int)")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies, taken)`` for every row; ``taken`` is ``copies`` times ``size``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    return _mixed(scratch.save(_sized(docs, F.monotonically_increasing_id(), id_col, text_col, source_col)), scratch, weights, most).drop("row")


def _sized(docs: DataFrame, number, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"), F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("h"), number.alias("row"),
    )


def _mixed(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], most: int) -> DataFrame:
    sizes = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    aim = targets(sizes, scratch, weights, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aim = aim.withColumn("times", F.least(times, F.lit(most)).cast("long"))
    aim = scratch.save(aim.withColumn("rest", F.col("target") - (F.col("times") * F.col("source_size")).cast("double")))

    out: list[DataFrame] = []
    waiting, budget = rows, aim.select("source", "rest")
    for level in range(BITS // STEP + -(-NUMBER_BITS // STEP)):
        waiting = waiting.withColumn("digit", _digit(level))
        sums = scratch.save(waiting.groupBy("source", "digit").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")))
        # the running sum of one source's histogram, 2 ** STEP rows at most
        reach = F.sum("b").over(Window.partitionBy("source").orderBy("digit"))
        named = budget.select(F.col("source").alias("of"), "rest")
        run = sums.withColumn("reach", reach).join(named, F.col("source").eqNullSafe(F.col("of"))).where(F.col("reach") > F.col("rest"))
        bound = run.groupBy("of").agg(F.min(F.struct("digit", "reach", "b", "c", "rest")).alias("x"))
        left = F.col("x.rest") - (F.col("x.reach") - F.col("x.b"))
        # a boundary of one row is settled; one that has no words left to give takes none
        alone = (F.col("x.c") == 1) | (left <= 0)
        last = F.when(alone, (2 * left >= F.col("x.b")) & (left > 0))
        cut = scratch.save(bound.select("of", F.col("x.digit").alias("edge"), (F.col("x.rest") > 0).alias("some"), left.alias("left"), last.alias("last")))
        judged = waiting.join(cut, F.col("source").eqNullSafe(F.col("of")), "left")
        more = F.col("edge").isNotNull() & F.col("some") & (F.col("digit") < F.col("edge"))  # a source without words has no edge
        judged = judged.withColumn("more", F.when(F.col("digit") == F.col("edge"), F.col("last")).otherwise(more))
        out.append(judged.where("more is not null").select("doc_id", "size", "source", "row", "more"))
        if cut.where("last is null").isEmpty():
            break
        waiting = scratch.save(judged.where("more is null").select("doc_id", "size", "source", "h", "row"))
        budget = cut.where("last is null").select(F.col("of").alias("source"), F.col("left").alias("rest"))
    decided = out[0]
    for df in out[1:]:
        decided = decided.unionByName(df)
    named = aim.select(F.col("source").alias("of"), "source_size", "target", "times")
    whole = decided.join(named, F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("times") + F.col("more").cast("long")
    return whole.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: ``docs`` with every row as often as it is taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    row, of, n, k = fresh(docs, "row", "of", "n", "k")
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()))
    copies = _mixed(scratch.save(_sized(rows, F.col(row), id_col, text_col, source_col)), scratch, weights, most)
    met = rows.join(copies.select(F.col("row").alias(of), F.col("copies").alias(n)), F.col(row) == F.col(of)).where(F.col(n) > 0)
    return met.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP12_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT source, CAST(s AS HUGEINT) AS s, CAST([5, 2, 1][(place - 1) % 3 + 1] AS HUGEINT) AS w, [2, 5, 10][(place - 1) % 3 + 1] * s AS ratio FROM s
), f AS (
  SELECT x.source, x.s, x.w,
         x.w * ((SELECT sum(s) FROM w) - coalesce((SELECT sum(3 * y.s) FROM w y WHERE y.ratio < x.ratio), 0))
           > 3 * x.s * (SELECT sum(y.w) FROM w y WHERE y.ratio >= x.ratio) AS is_full
  FROM w x
), t AS (
  SELECT source, CAST(s AS BIGINT) AS s,
         CASE WHEN is_full THEN CAST(3 * s AS DOUBLE)
              ELSE CAST(w * ((SELECT sum(s) FROM w) - coalesce((SELECT sum(3 * s) FROM f WHERE is_full), 0)) AS DOUBLE)
                   / CAST((SELECT sum(w) FROM f WHERE NOT is_full) AS DOUBLE) END AS target
  FROM f
), b AS (
  SELECT source, s, target, CASE WHEN s > 0 THEN least(3, CAST(floor(target / s) AS BIGINT)) ELSE 0 END AS times FROM t
), c AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reach FROM d
)
SELECT c.doc_id, c.size, b.s AS source_size, b.target, c.source, b.times + CASE WHEN 2 * c.reach - c.size <= 2 * (b.target - CAST(b.times * b.s AS DOUBLE)) AND b.target - CAST(b.times * b.s AS DOUBLE) > 0 THEN 1 ELSE 0 END AS copies,
       (b.times + CASE WHEN 2 * c.reach - c.size <= 2 * (b.target - CAST(b.times * b.s AS DOUBLE)) AND b.target - CAST(b.times * b.s AS DOUBLE) > 0 THEN 1 ELSE 0 END) * c.size AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
"""
