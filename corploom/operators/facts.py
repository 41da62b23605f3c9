"""Fact tables of a package: what its texts say, as relations to be asked in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexer
from ..functions import source_text as st
from ..functions.addresses import address_number
from ..functions.batches import by_text
from . import evidence, graph


def lines(functions: DataFrame) -> DataFrame:
    return functions.select("address", F.posexplode(st.lines(F.col("code"))).alias("at", "text")).select("address", (F.col("at") + 1).alias("line_no"), "text")


def definitions(functions: DataFrame) -> DataFrame:
    rows = functions.select("address", st.definition(F.col("code")).alias("d"), F.size(st.lines(F.col("code"))).alias("n_lines"))
    return rows.where("d is not null").select("address", "d.*", "n_lines")


def call_edges(functions: DataFrame) -> DataFrame:
    """``caller, callee, kind``: by name as callers are counted, by name as the catalog reads them, and as layers are built."""
    counted = graph.call_edges(functions, by_name=True).select("caller", "callee", F.lit("count").alias("kind"))
    named = graph.call_edges(functions).select("caller", "callee", F.lit("catalog").alias("kind"))
    ordered = graph.order_edges(functions).select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit("order").alias("kind"))
    return counted.unionByName(named).unionByName(ordered)


def arguments_of(code: str) -> list[tuple[str, int, int, str]]:
    """``callee_name, line_no, arg_index, arg_text`` of every bracketed call, blank arguments left out."""
    tk, out = lexer.Tokens(code, literals=False), []
    for opened, mark in enumerate(tk.mark):
        if mark == "(" and tk.mate[opened] >= 0 and tk.is_word(opened - 1) and tk.mark[opened - 1] not in lexer.KEYWORDS:
            for k, (a, b) in enumerate(lexer.arguments(tk, opened)):
                out.append((tk.mark[opened - 1], tk.line(tk.start[opened]), k, tk.text[tk.start[a] : tk.end[b - 1]]))
    return out


ARGUMENTS = "callee_name string, line_no int, arg_index int, arg_text string"


def call_arguments(functions: DataFrame) -> DataFrame:
    """``caller`` and ``arguments_of`` each text."""
    return by_text(functions, ["address", "code"], "code", lambda a, c: [(a, *x) for x in arguments_of(c or "")], f"caller string, {ARGUMENTS}")


def placeholders(functions: DataFrame) -> DataFrame:
    found = functions.select("address", F.explode(F.regexp_extract_all("code", F.lit(st.PLACEHOLDER), F.lit(0))).alias("symbol"))
    return found.groupBy("address", "symbol").agg(F.count(F.lit(1)).alias("n"))


def objects(facts: DataFrame) -> DataFrame:
    """``address, base, offsets``: byte offsets of each object, in order."""
    offs = evidence.effective_offsets(facts)
    return offs.groupBy("obj").agg(F.array_sort(F.collect_set("off")).alias("offsets")).select("obj.address", "obj.base", "offsets")


def flow_edges(functions: DataFrame) -> DataFrame:
    """``src, dst, kind``: calls between functions, and steps between the arguments of one call."""
    calls = graph.call_edges(functions).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("call").alias("kind"))
    return calls.unionByName(graph.argument_steps(functions).withColumn("kind", F.lit("argument")))


def tables(functions: DataFrame) -> dict[str, DataFrame]:
    """Every fact table of ``functions(address, ghidra_name, code, …)`` by name, lazily."""
    facts = evidence.access_facts(functions)
    return {
        "functions": functions.withColumn("addr_num", address_number(F.col("address"))), "lines": lines(functions), "definitions": definitions(functions), "call_edges": call_edges(functions),
        "call_sites": call_arguments(functions), "placeholders": placeholders(functions), "access_facts": facts, "objects": objects(facts), "flow_edges": flow_edges(functions),
    }


def write(functions: DataFrame, path: str, package: str) -> None:
    """All fact tables under ``path``, a folder each, this package's partition replaced."""
    for name, table in tables(functions).items():
        table.withColumn("package", F.lit(package)).write.partitionBy("package").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/{name}")


def register(spark: SparkSession, path: str, package: str | None = None) -> None:
    """Temporary views of the fact tables, of one package or of all, to be asked in SQL."""
    for name in ("functions", "lines", "definitions", "call_edges", "call_sites", "placeholders", "access_facts", "objects", "flow_edges"):
        table = spark.read.parquet(f"{path}/{name}")
        (table if package is None else table.where(F.col("package") == package)).createOrReplaceTempView(name)
