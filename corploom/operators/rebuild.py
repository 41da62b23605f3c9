"""The deterministic work round the passes of a reconstruction.

A pass is a function from rows to replies; what it asks, and of whom, is its
own business.  Here replies are parsed, checked against the original and the
registries, repaired once, reverted where they do not hold, and applied in
order of layers, callees first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import replies
from ..storage import Scratch
from . import graph, registry, validation

#: ``rows(address, …)`` -> ``(address, reply)``; a row without a reply has failed.
Pass = Callable[[DataFrame], DataFrame]

STRUCTS = "name string, fields array<struct<offset:bigint,name:string,type:string,size:bigint>>, size bigint, confidence string, evidence string, source_file string"
SYMBOLS = "symbol string, canonical_name string, kind string, inferred_type string, value string, confidence string, evidence string, source_file string"
ARTIFACTS = "address string, raw string, structured string, named string, naming_map string, status string, reason string"


@dataclass
class State:
    """The registries, and what did not fit them."""

    structs: DataFrame
    symbols: DataFrame
    conflicts: DataFrame

    @classmethod
    def empty(cls, spark) -> State:
        return cls(spark.createDataFrame([], STRUCTS), spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], "category string, name string, existing string, incoming string"))


def check(rows: DataFrame, parent: str, candidate: str, structs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``ok`` and ``report``: regressions of the candidate against its parent, and incoherent fields."""
    told = validation.regressions(rows.select("address", F.col(parent).alias("original"), F.col(candidate).alias("candidate"))).select("address", "errors")
    fields = validation.coherence_summary(validation.field_coherence(rows.select("address", F.col(candidate).alias("code")), structs, extra)).select("address", F.col("ok").alias("coherent"), F.col("report").alias("fields"))
    met = rows.join(told, "address").join(fields, "address")
    report = F.concat_ws("\n", F.array_join("errors", "\n"), F.when(~F.col("coherent"), F.col("fields")))
    return met.withColumn("ok", (F.size("errors") == 0) & F.col("coherent")).withColumn("report", report).drop("errors", "coherent", "fields")


def proposals(rows: DataFrame) -> DataFrame:
    """``address, name, fields, size, confidence, evidence`` of ``rows(address, updates)``, normal and sound."""
    tall = rows.select("address", F.posexplode("updates").alias("at", "u")).select("address", "at", "u.*")
    return registry.accepted_structs(tall)


def apply_layouts(state: State, rows: DataFrame, source: str, scratch: Scratch) -> DataFrame:
    """Fold ``rows(address, updates)`` into the registry, in order of address; returns each proposal's status."""
    asked = proposals(rows)
    seq = F.row_number().over(Window.partitionBy("name").orderBy("address", "at")).cast("long")
    asked = scratch.save(asked.withColumn("seq", seq))
    judged = scratch.save(registry.merge_layouts(asked.withColumn("source_file", F.lit(source)), state.structs))
    touched = registry.layouts(judged)
    before = state.structs
    state.structs = scratch.save(before.join(touched.select("name"), "name", "left_anti").unionByName(touched))
    lost = judged.where("status = 'conflict'").join(asked.select("name", "seq", F.to_json(F.struct("name", "fields", "size")).alias("incoming")), ["name", "seq"])
    lost = lost.select(F.lit("struct").alias("category"), "name", F.to_json(F.struct("fields", "size")).alias("existing"), "incoming")
    state.conflicts = scratch.save(state.conflicts.unionByName(lost))
    return judged


def structure(rows: DataFrame, state: State, ask: Pass, repair: Pass | None, source: str, scratch: Scratch) -> DataFrame:
    """``rows(address, code, …)`` with ``structured``, ``reason`` and ``failed``: a candidate that holds, or the original.

    A candidate that does not hold is repaired once, against the registry as it
    is then; a repair without proposals keeps those it was given.
    """
    reply = ask(rows).select("address", replies.structure_reply(F.col("reply")).alias("r"))
    got = rows.join(reply, "address", "left").select(*rows.columns, F.col("r.structured").alias("candidate"), "r.updates", F.col("r.skip").alias("skip"))
    got = scratch.save(got)
    no_text = F.coalesce("candidate", F.lit("")) == ""
    why = F.when(F.coalesce("skip", F.lit("")) != "", F.concat(F.lit("skipped: "), "skip")).otherwise("no reply")
    failed = got.where(no_text).select(*rows.columns, F.lit(None).cast("string").alias("structured"), why.alias("reason"), F.lit(True).alias("failed"))
    open_, done = got.where(~no_text).drop("skip"), []
    for attempt in range(2):
        seen = scratch.save(check(open_, "code", "candidate", state.structs, proposals(open_)))
        apply_layouts(state, seen.where("ok"), source, scratch)
        # a proposal may have been refused, so what held with it is looked at once more
        again = validation.coherence_summary(validation.field_coherence(seen.where("ok").select("address", F.col("candidate").alias("code")), state.structs)).select("address", F.col("ok").alias("still"), F.col("report").alias("late"))
        seen = scratch.save(seen.join(again, "address", "left").withColumn("holds", F.col("ok") & F.coalesce("still", F.lit(False))).withColumn("report", F.concat_ws("\n", F.nullif("report", F.lit("")), F.when(F.col("ok"), F.col("late")))))
        done.append(seen.where("holds").select(*rows.columns, F.col("candidate").alias("structured"), F.lit("").alias("reason"), F.lit(False).alias("failed")))
        open_ = seen.where("not holds").select(*rows.columns, "candidate", "updates", "report")
        if attempt or repair is None or open_.isEmpty():
            break
        fixed = repair(open_).select("address", replies.structure_reply(F.col("reply")).alias("r"))
        fixed = open_.join(fixed, "address", "left").select(*rows.columns, F.col("r.structured").alias("_new"), F.when(F.size("r.updates") > 0, F.col("r.updates")).otherwise(F.col("updates")).alias("updates"), "report")
        fixed = scratch.save(fixed)
        done.append(fixed.where("coalesce(_new, '') = ''").select(*rows.columns, F.col("code").alias("structured"), F.lit("reverted: empty repair").alias("reason"), F.lit(False).alias("failed")))
        open_ = fixed.where("_new <> ''").withColumnRenamed("_new", "candidate").drop("report")
    done.append(open_.select(*rows.columns, F.col("code").alias("structured"), F.concat(F.lit("reverted: "), "report").alias("reason"), F.lit(False).alias("failed")))
    out = failed
    for part in done:
        out = out.unionByName(part)
    return scratch.save(out)


def naming(rows: DataFrame, state: State, ask: Pass, source: str, scratch: Scratch) -> DataFrame:
    """``rows(address, structured, …)`` with ``named`` and ``naming_map``: the structured text under the reply's names.

    Locals are renamed by the map; names of symbols enter the registry, first
    write wins; a named text that does not hold gives way to its parent.
    """
    known = registry.placeholder_split(rows.select("address", F.col("structured").alias("code")), state.symbols)
    listed = known.groupBy("address").agg(
        F.to_json(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("place", "symbol", "canonical_name"))))).alias("known_symbols"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("known"), F.struct("place", "symbol"))))["symbol"], ", ").alias("unknown_symbols"),
    )
    reply = ask(rows.join(listed, "address", "left")).where(F.contains("reply", F.lit("<naming_map>")) & F.contains("reply", F.lit("<registry_updates>")))
    got = scratch.save(rows.join(reply.select("address", replies.naming_reply(F.col("reply")).alias("r")), "address", "left"))
    asked = got.where("r is not null").select("address", F.posexplode("r.updates").alias("at", "u")).select("address", "at", "u.*")
    asked = registry.accepted_names(asked).select("address", "at", "symbol", "canonical_name", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("inferred_type", "value", "confidence", "evidence")])
    values, order = ["canonical_name", "kind", "inferred_type", "value"], ["old", "address", "at"]
    before = state.symbols.select(F.lit("").alias("address"), F.lit(0).alias("at"), "symbol", *values, "confidence", "evidence", F.lit(0).alias("old"))
    judged = scratch.save(registry.first_write_wins(before.unionByName(asked.withColumn("old", F.lit(1))), "symbol", values, order))
    entries = registry.current_entries(judged, "symbol", [*values, "confidence", "evidence"], order)
    state.symbols = scratch.save(entries.select("symbol", *values, "confidence", "evidence", F.lit(source).alias("source_file")).select(*[x.split()[0] for x in SYMBOLS.split(", ")]))
    lost = registry.conflict_log(judged, "symbol", values, order, "symbol").where("old = 1")
    state.conflicts = scratch.save(state.conflicts.unionByName(lost.select("category", "name", "existing", "incoming")))
    spread = validation.renamed(got.where("r is not null").select("address", F.col("structured").alias("code"), F.col("r.naming_map").alias("naming_map")))
    spread = spread.select("address", F.col("code").alias("candidate"), F.array_join("log", "\n").alias("naming_map"))
    seen = check(got.drop("r").join(spread, "address"), "structured", "candidate", state.structs)
    named = F.when(F.col("ok"), F.col("candidate")).otherwise(F.col("structured"))
    fine = seen.select(*rows.columns, named.alias("named"), "naming_map")
    missing = got.where("r is null").select(*rows.columns, F.lit(None).cast("string").alias("named"), F.lit(None).cast("string").alias("naming_map"))
    return scratch.save(fine.unionByName(missing))


def run(functions: DataFrame, ask: Pass | None = None, repair: Pass | None = None, name: Pass | None = None, source: str = "", retries: int = 3, state: State | None = None) -> tuple[DataFrame, State]:
    """``ARTIFACTS`` of ``functions(address, ghidra_name, code, …)`` and the registries after them.

    Layers are taken leaf first, cycles last.  What fails in a layer is asked
    again up to ``retries`` times; if something still fails, later layers are
    not run, since their callees are not there.
    """
    spark = functions.sparkSession
    scratch = Scratch(spark, "rebuild")
    state = state or State.empty(spark)
    layered = scratch.save(graph.layers(functions, "address", graph.order_edges(functions)).join(functions, "address"))
    depths = [r["depth"] for r in layered.select("depth").distinct().orderBy(F.col("depth").asc_nulls_last()).collect()]  # one row a layer
    parts: list[DataFrame] = []
    stopped = False
    for depth in depths:
        layer = layered.where(F.col("depth").eqNullSafe(F.lit(depth))).drop("depth", "is_cycle")
        if stopped:
            parts.append(layer.select("address", F.col("code").alias("raw"), *[F.lit(None).cast("string").alias(c) for c in ("structured", "named", "naming_map")], F.lit("not run").alias("status"), F.lit("").alias("reason")))
            continue
        for attempt in range(retries + 1):
            rows = structure(layer, state, ask, repair, source, scratch) if ask else layer.withColumns({"structured": F.col("code"), "reason": F.lit(""), "failed": F.lit(False)})
            bad, good = rows.where("failed"), rows.where("not failed")
            if name:
                good = naming(good, state, name, source, scratch)
                bad = bad.unionByName(good.where("named is null").drop("named", "naming_map").withColumn("failed", F.lit(True)).withColumn("reason", F.lit("no naming reply")))
                good = good.where("named is not null")
            else:
                good = good.withColumns({"named": F.col("structured"), "naming_map": F.lit("")})
            parts.append(scratch.save(good.select("address", F.col("code").alias("raw"), "structured", "named", "naming_map", F.lit("produced").alias("status"), "reason")))
            bad = scratch.save(bad)
            if bad.isEmpty():
                break
            layer = bad.select(*layer.columns)
            if attempt == retries:
                stopped = True
                parts.append(bad.select("address", F.col("code").alias("raw"), *[F.lit(None).cast("string").alias(c) for c in ("structured", "named", "naming_map")], F.lit("failed").alias("status"), "reason"))
    out = spark.createDataFrame([], ARTIFACTS)
    for p in parts:
        out = out.unionByName(p)
    return out, state
