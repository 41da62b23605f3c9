"""C-like text made of the driver's parts, and the same things as columns in SQL.

The driver's tables hold no C text, so a function is made of each part: the
operators read its text, the SQL its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def address(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 8, "0")


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """``address, ghidra_name, name, code``: part k calls the part at half its key and the part that its size names, and mentions the one at a third.

    A megabyte of the table makes a hundred of text, so its rows are dealt to tasks before: few bytes are one split.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size").repartition(parts, "k")
    k, size, quoted = F.col("k"), F.col("p_size"), F.concat(F.lit('"'), "p_name", F.lit('"'))
    text = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    half, third = F.expr("(k - 1) div 2"), F.expr("k div 3")
    at = (k % 5) * 4
    code = F.concat_ws(
        "\n", F.when(k % 4 == 0, text("void *fn_", k, "(void)")).otherwise(text("int fn_", k, "(int size, char *name)")), F.lit("{"), text("  struct s_", size, " *p;"),
        F.when(k == 0, "  idle();").when(k % 3 == 0, text("  fn_", half, "(", quoted, ", ", size, ");")).otherwise(text("  fn_", half, "(", size, ", ", quoted, ");")),
        text("  fn_", size, "(0);"), text("  FUN_", address(third), "();"), text("  p->f_", k % 7, " = ", size, ";"),
        F.when(k % 2 == 1, text("  use(*(int *)(p + ", at, ") + *(short *)(p + 64), name);")).otherwise(text("  *(int *)(p + ", at, ") = DAT_", F.lower(F.hex(k % 50)), ";")),
        F.lit("  return 0;"), F.lit("}"),
    )
    name = text("fn_", k)
    return p.select(address(k).alias("address"), name.alias("ghidra_name"), name.alias("name"), code.alias("code"))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """``symbol, canonical_name, kind, inferred_type, value, confidence``: data named by suppliers, functions by small parts."""
    s, p = _t(spark, sf, "supplier"), _t(spark, sf, "part").where("p_size <= 10")
    data = s.where("s_suppkey < 30").select(F.concat(F.lit("DAT_"), F.lower(F.hex("s_suppkey"))).alias("symbol"), F.replace("s_name", F.lit("#"), F.lit("_")).alias("canonical_name"), F.lit("global_var").alias("kind"))
    code = p.select(F.concat(F.lit("FUN_"), address(F.col("p_partkey"))).alias("symbol"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("canonical_name"), F.lit("function").alias("kind"))
    rest = [F.lit("").alias("inferred_type"), F.lit("").alias("value"), F.lit("high").alias("confidence")]
    return data.unionByName(code).select("symbol", "canonical_name", "kind", *rest)


def structs(spark: SparkSession, sf: str) -> DataFrame:
    """``name, fields, size``: of each size the fields that parts with an even key use."""
    p = _t(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("s_"), F.col("p_size").cast("string")).alias("name"), (F.col("p_partkey") % 7).alias("f")).distinct()
    one = F.struct((F.col("f") * 4).cast("long").alias("offset"), F.concat(F.lit("f_"), F.col("f").cast("string")).alias("name"), F.lit("int").alias("type"), F.lit(4).cast("long").alias("size"))
    return p.groupBy("name").agg(F.array_sort(F.collect_list(one)).alias("fields")).withColumn("size", F.lit(0).cast("long"))  # seven fields at most


ADDRESS = "lpad(printf('%x', {}), 8, '0')"

#: Parts as functions: key, size, half, third, address and name.
FN = f"""fn AS (SELECT p_partkey AS k, p_name, p_size AS size, (p_partkey - 1) // 2 AS half, p_partkey // 3 AS third, {ADDRESS.format('p_partkey')} AS address, 'fn_' || p_partkey AS name FROM part)"""

#: Calls by name: caller, callee, line and text of the line.
CALLS = """calls AS (
  SELECT k AS src, half AS dst, 4 AS line_no, CASE WHEN k % 3 = 0 THEN 'fn_' || half || '("' || p_name || '", ' || size || ');' ELSE 'fn_' || half || '(' || size || ', "' || p_name || '");' END AS snippet FROM fn WHERE k > 0
  UNION ALL SELECT k, size, 5, 'fn_' || size || '(0);' FROM fn
), edges AS (SELECT DISTINCT src, dst FROM calls WHERE src <> dst AND dst IN (SELECT k FROM fn))"""

SYMBOLS = f"""sym AS (
  SELECT 'DAT_' || printf('%x', s_suppkey) AS symbol, replace(s_name, '#', '_') AS canonical_name FROM supplier WHERE s_suppkey < 30
  UNION ALL SELECT 'FUN_' || {ADDRESS.format('p_partkey')}, replace(p_name, ' ', '_') FROM part WHERE p_size <= 10)"""
