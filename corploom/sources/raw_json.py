"""Raw function packages: a folder of JSON files, one function in each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import normalize_address

SCHEMA = "address string, ghidra_name string, code string, pcode string"


def read_functions(spark: SparkSession, path: str) -> DataFrame:
    """``SCHEMA`` rows, one for each address.

    Files whose names begin with an underscore are passed over and a malformed
    file fails the read.  A row without a valid address goes; of several with
    one address the last file by path stands.  Missing texts are empty.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    rows = raw.withColumn("address", normalize_address(F.col("address"))).where("address <> ''")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("ghidra_name", "code", "pcode")]
    last = rows.groupBy("address").agg(F.max_by(F.struct(*texts), "_file").alias("r"))
    return last.select("address", "r.*")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Generated sources named 0x<address>_<name>.c: ``address, file_name, code, name``.

    The name is that of the first definition, else the file's, else FUN_<address>.
    """
    from ..functions.source_text import definition

    raw = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("code"), F.col("_metadata.file_name").alias("file_name"))
    address = normalize_address(F.regexp_extract("file_name", r"^0x([0-9a-fA-F]+)", 1))
    token = F.regexp_extract("file_name", r"^0x[0-9a-fA-F]+_(.+)\.c(?:pp)?$", 1)
    rows = raw.select(address.alias("address"), "file_name", "code", F.nullif(token, F.lit("")).alias("_token")).where("address <> ''")
    return rows.select("address", "file_name", "code", F.coalesce(definition(F.col("code"))["name"], "_token", F.concat(F.lit("FUN_"), "address")).alias("name"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per-function summaries, a JSON file each in a folder named by the address; broken files become rows of nulls."""
    schema = (
        "function_name_suggestion string, summary string, security_relevance struct<level:string,reason:string>, confirmed_behaviors array<string>, "
        "side_effects array<string>, important_strings array<string>, api_calls array<string>, confidence string"
    )
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "summary.json").option("recursiveFileLookup", True).json(path)
    return raw.select(F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1).alias("address"), *[x.split()[0] for x in schema.split(", ")])


def summary_inputs(artifacts: DataFrame) -> DataFrame:
    """``address, text`` of the functions that have a named text, with their naming map behind it where there is one."""
    named = artifacts.where("coalesce(named, '') <> ''")
    return named.select("address", F.when(F.coalesce("naming_map", F.lit("")) != "", F.concat("named", F.lit("\n\nNAMING_MAP:\n"), "naming_map")).otherwise(F.col("named")).alias("text"))


def write_functions(functions: DataFrame, path: str) -> None:
    """Function packages as JSON, a line each; ``read_lines`` reads them back."""
    functions.select(F.to_json(F.struct("address", "ghidra_name", "code", "pcode")).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``SCHEMA`` rows of a package written by ``write_functions``; a malformed line fails the read."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def read_package(spark: SparkSession, path: str, pinned: str | None = None) -> DataFrame:
    """The raw package, or the pinned snapshot in its place (Parquet, or a folder of JSON); a snapshot is taken as it is."""
    if pinned is None:
        return read_functions(spark, path)
    if pinned.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(pinned).select("address", "ghidra_name", "code", "pcode")
    return read_functions(spark, pinned)
