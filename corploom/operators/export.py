"""Export names and the corpus-wide placeholder map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import symbol_address
from ..functions.source_text import PLACEHOLDER, definition, file_token, renamed_definition


def base_names(functions: DataFrame, symbols: DataFrame) -> DataFrame:
    """``address, base``: the registry's name of a function, else that of its first definition."""
    known = symbols.where("kind = 'function'").select(F.col("symbol").alias("ghidra_name"), "canonical_name")
    met = functions.join(known, "ghidra_name", "left")
    return met.select("address", F.coalesce("canonical_name", definition(F.col("code"))["name"], "ghidra_name").alias("base"))


def unique_names(bases: DataFrame) -> DataFrame:
    """``address, name``: the base name, with the address where several share it."""
    n = bases.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    return bases.join(n, "base").select("address", F.when(F.col("n") > 1, F.concat("base", F.lit("_0x"), "address")).otherwise(F.col("base")).alias("name"))


def export_map(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """``old, new`` of made-up names: functions take their export name, others, and functions without one, their canonical one."""
    made_up = symbols.where(F.col("symbol").rlike(r"\A(?:" + PLACEHOLDER + r")\z"))
    told = made_up.withColumn("address", F.when(F.col("kind") == "function", symbol_address(F.col("symbol")))).join(names, "address", "left")
    return told.select(F.col("symbol").alias("old"), F.coalesce("name", "canonical_name").alias("new")).where("old <> new")


def rename_definitions(sources: DataFrame, bases: DataFrame, names: DataFrame) -> DataFrame:
    """``address, code`` with the first definition of each base name under its export name."""
    met = sources.join(bases, "address", "left").join(names, "address", "left")
    return met.select("address", F.when(F.col("base").isNull() | F.col("name").isNull(), F.col("code")).otherwise(renamed_definition(F.col("code"), F.col("base"), F.col("name"))).alias("code"))


def source_files(sources: DataFrame, prologue: str) -> DataFrame:
    """``address, file_name, content`` of ``sources(address, name, code)``; empty texts have no file."""
    token = file_token(F.col("name"))
    file = F.concat(F.lit("0x"), "address", F.when(token != "", F.concat(F.lit("_"), token)).otherwise(""), F.lit(".c"))
    return sources.where("code <> ''").select("address", file.alias("file_name"), F.concat(F.lit(prologue), "code").alias("content"))


def file_names(sources: DataFrame) -> DataFrame:
    """``address, old, new`` where a file's name no longer says what its function is called; names without a token stay."""
    token = F.regexp_extract("file_name", r"^0x[0-9a-fA-F]+_(.+)\.c$", 1)
    head = F.regexp_extract("file_name", r"^(0x[0-9a-fA-F]+)_", 1)
    want = F.concat(head, F.lit("_"), file_token(F.col("name")), F.lit(".c"))
    return sources.where((token != "") & (token != F.col("name"))).select("address", F.col("file_name").alias("old"), want.alias("new")).where("old <> new")
