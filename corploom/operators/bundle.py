"""The evidence text that goes with a function: objects, kin, consensus, callees, control flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.source_text import hexed
from . import catalog, corpus, evidence, similarity

#: Longest bundle, and what is taken of each part.
MOST, KIN, CALLEES, EXCERPT = 12_000, 3, 4, 900
#: Facts shown of each offset, of each kin, and characters of the text round them.
SHOWN, OWN_CONTEXT, KIN_CONTEXT = 2, 1600, 1400


def _plus(c: Column) -> Column:
    return F.concat(F.lit("+"), hexed(c))


def _listed(rows: DataFrame, by: list[str], order: list[str], text: Column, most: int | None = None) -> DataFrame:
    """``by, block``: the texts of each group in order, a line each."""
    if most is not None:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= most)
    lines = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))).alias("x"))
    return lines.select(*by, F.array_join("x._t", "\n").alias("block"))


def _chosen(facts: DataFrame, by: list[str], functions: DataFrame, most: int) -> DataFrame:
    """The facts shown of each group: writes first, then those passed to a call; with the text round them."""
    order = [F.col("access_mode") != "write", F.col("callee") == "", F.col("offset"), F.col("line_no")]
    rows = facts.withColumn("_group", F.struct(*by))
    first = corpus.pick_facts(rows, "_group", "snippet", order, SHOWN)
    code = functions.select("address", "code")
    return first.join(code, "address").withColumn("context", corpus.text_around(F.col("code"), F.col("line_no"), most=most)).drop("code")


def _indented(text: Column, by: str) -> Column:
    return F.concat(F.lit(by), F.replace(text, F.lit("\n"), F.lit("\n" + by)))


def object_lines(facts: DataFrame, functions: DataFrame) -> DataFrame:
    """``address, base, block``: for each object its offsets with sizes, types, calls, roles and the first uses."""
    rows = evidence.offset_digest(facts)
    sizes = F.when(F.size("sizes") > 0, F.array_join(F.transform("sizes", lambda s: F.concat(s.cast("string"), F.lit("B"))), ", ")).otherwise("unknown size")
    said = lambda c, title, sep=", ": F.when(F.size(c) > 0, F.concat(F.lit(f"; {title} "), F.array_join(c, sep))).otherwise("")
    line = F.concat(
        F.lit("  "), _plus(F.col("offset")), F.lit(": "), sizes, F.lit("; "), F.array_join("types", ", "), F.lit("; "), F.array_join("modes", ", "), said("calls", "calls", "; "), said("roles", "roles"),
        F.when(F.size("bytes") > 0, F.concat(F.lit("; bytes "), F.array_join(F.transform("bytes", _plus), ", "))).otherwise(""),
    )
    rows = rows.select("address", "base", "offset", line.alias("line"))
    uses = _chosen(facts, ["address", "base", "offset"], functions, OWN_CONTEXT)
    shown = F.concat(F.format_string("    line %d: %s\n", "line_no", "snippet"), _indented(F.col("context"), "      "))
    uses = _listed(uses, ["address", "base", "offset"], ["place"], shown).withColumnRenamed("block", "uses")
    told = rows.join(uses, ["address", "base", "offset"], "left").select("address", "base", "offset", F.concat_ws("\n", "line", "uses").alias("t"))
    blocks = _listed(told, ["address", "base"], ["offset"], F.col("t"))
    return blocks.select("address", "base", F.concat(F.lit("object "), "base", F.lit("\n"), "block").alias("block"))


def kin_lines(facts: DataFrame, functions: DataFrame) -> DataFrame:
    """``address, base, block``: the objects most alike, a covering writer second, what they do at the shared offsets, and offsets that three functions share."""
    offs = evidence.effective_offsets(facts)
    near = similarity.related(offs, evidence.shared_calls(facts), KIN + 1, writer=True)
    agreed = similarity.consensus(near, offs, evidence.uses(facts))
    contract = F.concat(F.lit("    "), _plus(F.col("off")), F.lit(": "), F.array_join("functions", ", "), F.when(F.col("sites") > 3, F.format_string(" (%d functions)", "sites")).otherwise(""), F.when(F.size("calls") > 0, F.concat(F.lit("; calls "), F.array_join("calls", ", "))).otherwise(""))
    agreed = _listed(agreed, ["obj"], ["off"], contract).select("obj", F.concat(F.lit("  repeated in three functions or more:\n"), "block").alias("contract"))

    near = near.where(F.col("place") <= KIN)
    own = offs.select(F.col("obj").alias("a"), "off").distinct()
    theirs = offs.select(F.col("obj").alias("b"), "off").distinct()
    met = near.select("a", "b").join(own, "a").join(theirs, ["b", "off"], "left_semi")
    shared = met.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_set("off")), _plus), ", ").alias("shared"))
    at = facts.withColumn("b", F.struct("address", "base")).withColumn("off", evidence.raw_offset())
    uses = _chosen(met.join(at, ["b", "off"]), ["a", "b"], functions, KIN_CONTEXT)
    shown = F.concat(F.format_string("    %s line %d: %s\n", "access_mode", "line_no", "snippet"), _indented(F.col("context"), "      "))
    uses = _listed(uses.withColumnRenamed("place", "n"), ["a", "b"], ["n"], shown).withColumnRenamed("block", "uses")
    line = F.format_string("  kin 0x%s %s: %d offsets shared (%s), score %.2f", "b.address", "b.base", "overlap", "shared", "score")
    kin = near.join(shared, ["a", "b"]).join(uses, ["a", "b"], "left").withColumn("t", F.concat_ws("\n", line, "uses"))
    kin = _listed(kin, ["a"], ["place"], F.col("t"))
    told = kin.join(agreed, F.col("a") == F.col("obj"), "left")
    return told.select("a.address", "a.base", F.concat_ws("\n", "contract", "block").alias("block"))


def callee_lines(facts: DataFrame, functions: DataFrame) -> DataFrame:
    """``address, base, block``: the first callees that the object's fields, then the object itself, are passed to, with their text's beginning."""
    passed = facts.where("callee <> ''").select("address", "base", F.col("callee").alias("name"), F.lit(0).alias("way"), F.col("line_no").alias("at"))
    objects = facts.select("address", "base").distinct()
    whole = evidence.plain_arguments(functions).select("address", "base", F.col("callee").alias("name"), F.lit(1).alias("way"), F.col("place").alias("at"))
    both = passed.unionByName(whole.join(objects, ["address", "base"], "left_semi"))
    named = functions.where("ghidra_name <> ''").groupBy(F.col("ghidra_name").alias("name")).agg(F.min(F.struct("address", F.substring(F.trim("code"), 1, EXCERPT).alias("body"))).alias("c"))
    first = both.groupBy("address", "base", "name").agg(F.min(F.struct("way", "at")).alias("o")).join(named, "name")
    first = first.where((F.col("c.address") != F.col("address")) | (F.col("o.way") == 0)).select("address", "base", "name", "o", F.col("c.body").alias("body"))
    return _listed(first, ["address", "base"], ["o", "name"], F.concat(F.lit("  callee "), "name", F.lit(":\n"), "body"), CALLEES)


def tail_lines(functions: DataFrame) -> DataFrame:
    """``address, block``: the text behind the labels that gotos name."""
    text = F.concat(F.format_string("label %s (line %d):\n", "label", "line_no"), "body", F.when(F.col("cut"), "\n  ...(cut)").otherwise(""))
    return _listed(catalog.goto_tails(functions), ["address"], ["place"], text)


def bundles(functions: DataFrame) -> DataFrame:
    """``address, bundle`` of ``functions(address, ghidra_name, code)``; functions without evidence are left out."""
    facts = evidence.access_facts(functions)
    objects = object_lines(facts, functions).withColumnRenamed("block", "own")
    met = objects.join(kin_lines(facts, functions).withColumnRenamed("block", "kin"), ["address", "base"], "left").join(callee_lines(facts, functions).withColumnRenamed("block", "callees"), ["address", "base"], "left")
    text = _listed(met.withColumn("t", F.concat_ws("\n", "own", "kin", "callees")), ["address"], ["base"], F.col("t")).withColumnRenamed("block", "objects")
    whole = text.join(tail_lines(functions).withColumnRenamed("block", "tails"), "address", "full").select("address", F.concat_ws("\n", "objects", "tails").alias("t"))
    cut = F.when(F.length("t") > MOST, F.concat(F.rtrim(F.substring("t", 1, MOST)), F.lit("\n...(cut)"))).otherwise(F.col("t"))
    return whole.select("address", cut.alias("bundle"))
