"""Command line: a raw package through filters, layers, evidence, review and export.

``python -m corploom PACKAGE OUT`` reads function packages, drops runtime stubs
and overlapping entries, runs the passes that ``--passes`` names, and leaves
under OUT the files that people and compilers read (``reconstruction``,
``codeql/src``, ``reports``) beside the tables that they were made of.

The module of passes may have these functions, all of them optional; whatever
they ask, and of whom, is their own business:

* ``configure(settings)`` is called first, with time limits, reasoning and whatever else the settings' file says;
* ``structure``, ``repair``, ``name``: rows of a layer to replies (``rebuild.Pass``); the rows have ``context`` (what the settings' context says of the domain), ``language``, ``bundle`` and ``pcode``;
* ``prescan(explorer)`` answers with ``(section, content)`` rows that are merged with the noise scan; ``review(explorer, role, catalog)`` with ``(address, code)`` rows that replace texts; the role is None, or each of ``tools.ROLES`` if several review at once;
* ``summary()`` makes a function from prompts to replies, called once in each task;
* ``database(out)`` builds a code database from the sources and tells whether it could.
"""

from __future__ import annotations

import argparse
import importlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings as st
from .functions.source_text import definition
from .operators import bundle, catalog, corpus, edits, evidence, export, facts, rebuild, registry, sections, tools, validation
from .sources import files, raw_json, sinks

#: What a run comes to: all came through; nothing to do, or settings that can't be; a function failed, so nothing is exported; the database is missing.
DONE, REFUSED, PARTIAL, NO_DATABASE = 0, 1, 2, 3
FUNCTIONS, REGISTRY, SOURCES = "functions", "registry", "codeql/src"
PROLOGUE = '#include "types.h"\n#include "decls.h"\n\n'


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="corploom", description=__doc__.splitlines()[0])
    p.add_argument("package", help="folder of function packages")
    p.add_argument("out", help="folder of the results")
    p.add_argument("--settings", help="YAML file")
    p.add_argument("--contexts", default="contexts", help="folder of the contexts that settings name")
    p.add_argument("--pin-raw-from", help="take this package instead, as it is")
    p.add_argument("--passes", help="module with functions structure, repair, name, prescan, review, summary, database; any of them may be missing")
    p.add_argument("--summaries", help="folder of summaries; the report's evidence is written too")
    p.add_argument("--skip-database", action="store_true", help="make no fact tables and no database")
    p.add_argument("--reconstruction-workers", type=int, help="tasks that ask at a time, in place of the settings' number")
    return p.parse_args(argv)


def chosen_settings(args: argparse.Namespace) -> st.Settings:
    """The settings' file with the command line over it; a number of workers below one is an error."""
    chosen = st.load(args.settings) if args.settings else st.Settings()
    toggles = chosen.toggles
    if args.skip_database:
        toggles = replace(toggles, skip_database=True)
    if args.reconstruction_workers is not None:
        toggles = replace(toggles, reconstruction_workers=args.reconstruction_workers)
    if toggles.reconstruction_workers < 1:
        raise ValueError("there must be one worker at least")
    return replace(chosen, toggles=toggles)


def export_sources(artifacts: DataFrame, functions: DataFrame, state: rebuild.State, prologue: str) -> dict[str, DataFrame]:
    """``sources`` (files), ``unresolved`` names and ``fallbacks``, of the artifacts under the registries' names."""
    made = artifacts.where("status = 'produced'")
    bases = export.base_names(made.join(functions.select("address", "ghidra_name"), "address").select("address", "ghidra_name", F.col("named").alias("code")), state.symbols)
    names = export.unique_names(bases)
    mapping = export.export_map(state.symbols, names)
    texts = {}
    for c in ("named", "structured", "raw"):
        replaced = registry.replace_symbols(made.select("address", F.col(c).alias("code")), "address", "code", mapping).drop("hits")
        texts[c] = export.rename_definitions(replaced, bases, names).withColumnRenamed("code", c)
    candidates = texts["named"].join(texts["structured"], "address").join(texts["raw"], "address")
    chosen = validation.choose_export(candidates, state.structs)
    final = chosen.select("address", F.col("text").alias("code"), "chosen", "summary").join(names, "address")
    left = registry.placeholder_split(final, state.symbols.limit(0)).select(F.concat(F.lit("0x"), "address").alias("func"), "symbol")
    return {"sources": export.source_files(final, prologue), "unresolved": sinks.unresolved(left), "fallbacks": final.where("chosen <> 'named'").select("address", "chosen", "summary")}


def asked_rows(functions: DataFrame, chosen: st.Settings) -> DataFrame:
    """The functions with what a pass is told besides: evidence, relevant operations, language."""
    toggles, rows = chosen.toggles, functions
    if not toggles.disable_access_evidence:
        rows = rows.join(bundle.bundles(functions), "address", "left")
    pcode = F.lit("") if toggles.disable_pcode else catalog.relevant_pcode(F.col("pcode"), F.col("code"))
    return rows.withColumns({"pcode": pcode, "language": F.lit(st.language_line(chosen.language))})


def asker(hook, layer: str, args: argparse.Namespace, chosen: st.Settings):
    """A pass that is told of the domain and asks in as many tasks as there are workers."""
    if hook is None:
        return None
    told = "" if chosen.toggles.disable_domain_context or not chosen.context else st.load_context(args.contexts, chosen.context, layer)
    workers = chosen.toggles.reconstruction_workers
    return lambda rows: hook(rows.withColumn("context", F.lit(told)).repartition(workers, "address"))


def reviewed(sources: DataFrame, functions: DataFrame, state: rebuild.State, passes, toggles: st.Toggles, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sources(address, file_name, content)`` after a review, its ``changes``, and the catalog's sections."""
    changes = spark.createDataFrame([], "seq long, agent string, tool string, address string")
    merged = spark.createDataFrame([], "section string, content string")
    if toggles.skip_agent_review or passes is None:
        return sources, changes, merged
    named = lambda rows: tools.Explorer(rows.join(functions.select("address", "ghidra_name"), "address").select("address", "ghidra_name", F.col("content").alias("code")), state.symbols, state.structs)
    if toggles.enable_prescan:
        noise = corpus.noise_counts(sources, "file_name", "content")
        told = passes.prescan(named(sources)) if hasattr(passes, "prescan") else merged
        merged = sections.with_scan(told.select("section", "content"), sections.scan(noise, "file_name"))
    if hasattr(passes, "review"):
        for k, role in enumerate(tools.ROLES if toggles.enable_multi_agent else [None]):
            asked = passes.review(named(sources), role, merged)
            if role is not None and not set(tools.ROLES[role]) & set(tools.EDIT):
                asked = asked.limit(0)  # a role that only reads
            new = edits.rewrite(sources.select("address", F.col("content").alias("code")), asked, PROLOGUE).select("address", F.col("code").alias("_new"))
            met = sources.join(new, "address")
            touched = met.where("content <> _new").select(F.lit(k).cast("long").alias("seq"), F.lit(role or "review").alias("agent"), F.lit("rewrite").alias("tool"), "address")
            sources, changes = met.withColumn("content", F.col("_new")).drop("_new"), changes.unionByName(touched)
    return sources, changes, merged


def header_files(sources: DataFrame, state: rebuild.State) -> DataFrame:
    """``path, rank, key, content`` of the headers that sources include."""
    spark = sources.sparkSession
    part = lambda path, df: df.select(F.lit(f"{SOURCES}/{path}").alias("path"), F.col("rank").cast("int").alias("rank"), "key", "content")
    stubs = part("stubs.h", spark.createDataFrame([(0, "", sinks.stub_header())], "rank int, key string, content string"))
    types = part("types.h", sinks.types_parts(state.structs).select(F.col("place").alias("rank"), F.col("name").alias("key"), "content"))
    out = stubs.unionByName(types)
    lists = {"macros.h": sinks.macro_lines(state.symbols), "globals.h": sinks.global_lines(state.symbols), "decls.h": sinks.declaration_lines(sources.select(F.col("content").alias("code")))}
    for name, lines in lists.items():
        guard = f"CORPLOOM_{name.removesuffix('.h').upper()}_H"
        ends = spark.createDataFrame([(0, "", f"#ifndef {guard}\n#define {guard}\n\n"), (2, "", f"\n#endif /* {guard} */\n")], "rank int, key string, content string")
        out = out.unionByName(part(name, ends)).unionByName(part(name, lines.select(F.lit(1).alias("rank"), F.col("line").alias("key"), F.concat("line", F.lit("\n")).alias("content"))))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """``DONE``, ``REFUSED``, ``PARTIAL`` or ``NO_DATABASE``."""
    args = arguments(argv)
    try:
        chosen = chosen_settings(args)
    except (ValueError, FileNotFoundError) as e:
        print(f"corploom: {e}")
        return REFUSED
    toggles, out = chosen.toggles, args.out
    spark = spark or SparkSession.builder.appName("corploom").getOrCreate()
    sinks.reset(spark, *[f"{out}/{x}" for x in ("reconstruction", "codeql", "manifest", "sources")])  # an older run must not look like this one
    functions, counts = corpus.select_functions(raw_json.read_package(spark, args.package, args.pin_raw_from))
    if not args.pin_raw_from:
        functions = corpus.without_overlaps(functions)
    functions.write.mode("overwrite").parquet(f"{out}/functions")
    functions = spark.read.parquet(f"{out}/functions")
    if functions.isEmpty():
        return REFUSED
    passes = importlib.import_module(args.passes) if args.passes else None
    if hasattr(passes, "configure"):
        passes.configure(chosen)
    use = lambda name, layer, off: None if off else asker(getattr(passes, name, None), layer, args, chosen)
    structure, repair, name = use("structure", "structure", toggles.skip_structure), use("repair", "structure", toggles.skip_structure), use("name", "naming", toggles.skip_naming)
    rows = asked_rows(functions, chosen) if structure or name else functions
    artifacts, state = rebuild.run(rows, structure, repair, name, source=args.package)
    sinks.write_artifacts(artifacts, f"{out}/artifacts")
    artifacts = spark.read.parquet(f"{out}/artifacts")

    def table(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    structs, symbols = table("structs", state.structs), table("symbols", state.symbols)
    state = rebuild.State(structs, symbols, table("conflicts", state.conflicts))
    table("counts", counts)
    whole = artifacts.where("status <> 'produced'").isEmpty()
    texts = artifacts.join(functions.select("address", "pcode"), "address")
    if not toggles.disable_access_evidence and (structure or name):
        texts = texts.join(rows.select("address", F.col("bundle").alias("access_evidence")), "address", "left")
    of_each = sinks.function_files(texts, FUNCTIONS, {"pcode": "pcode.txt", "access_evidence": "access_evidence.txt"})
    parts = of_each.select("path", F.lit(0).alias("rank"), F.lit("").alias("key"), "content")
    parts = parts.unionByName(sinks.symbol_files(symbols, REGISTRY))
    lost = artifacts.where("status = 'failed'").select("address", definition(F.col("raw"))["name"].alias("name"), "reason")
    parts = parts.unionByName(sinks.line_file(sinks.skipped_lines(lost), "skipped.txt", ["line"]))
    if not toggles.disable_access_evidence:
        parts = parts.unionByName(sinks.evidence_file(evidence.evidence_json(evidence.access_facts(functions)), "access_evidence.json"))

    built = not toggles.skip_database
    if whole:
        tables = export_sources(artifacts, functions, state, PROLOGUE)
        sources, changes, merged = reviewed(table("exported", tables["sources"]), functions, state, passes, toggles, spark)
        sources = table("sources", sources)
        table("changes", changes), table("sections", merged), table("fallbacks", tables["fallbacks"])
        parts = parts.unionByName(sinks.unresolved_file(table("unresolved", tables["unresolved"]), f"{REGISTRY}/unresolved_symbols.txt"))
        code = sources.select(F.concat(F.lit(f"{SOURCES}/"), "file_name").alias("path"), F.lit(0).alias("rank"), F.lit("").alias("key"), "content")
        files.save(code.unionByName(header_files(sources, state)).withColumn("path", F.expr(f"substr(path, {len(SOURCES) + 2})")), f"{out}/{SOURCES}", ["rank", "key"])
        if built:
            facts.write(functions, f"{out}/facts", st.safe_name(args.package.rstrip("/").rsplit("/", 1)[-1]))
            built = passes.database(out) if hasattr(passes, "database") else True
        report(spark, args, artifacts, passes, f"{out}/reports")
    told = sinks.manifest(artifacts, built and whole)
    told = table("manifest", told.withColumn("full_success", F.lit(whole and (built or toggles.skip_database))))
    parts = parts.unionByName(sinks.manifest_file(told, sinks.manifest_entries(artifacts), "completeness_manifest.json"))
    files.save(parts, f"{out}/reconstruction", ["rank", "key"])
    if not whole:
        return PARTIAL
    return DONE if built or toggles.skip_database else NO_DATABASE


def report(spark: SparkSession, args: argparse.Namespace, artifacts: DataFrame, passes, folder: str) -> None:
    """Summaries that were given or are asked for, and the report's evidence."""
    if args.summaries:
        told = raw_json.read_summaries(spark, args.summaries)
    elif hasattr(passes, "summary"):
        prompt = F.concat("named", F.lit("\n\nNAMING_MAP:\n"), F.coalesce("naming_map", F.lit("")))
        told = tools.summaries(tools.completions(artifacts.select("address", prompt.alias("prompt")), passes.summary))
    else:
        return
    rows = sinks.summaries(told).withColumn("address", F.regexp_replace("address", "^0[xX]", ""))
    rows.write.mode("overwrite").parquet(f"{args.out}/summaries")
    rows = spark.read.parquet(f"{args.out}/summaries")
    found = sinks.report_appendix(sinks.risk_candidates(rows, artifacts))
    each = rows.select(F.format_string("summaries/0x%s.json", "address").alias("path"), F.lit(0).alias("rank"), F.lit("").alias("key"), F.to_json(F.struct(*rows.columns)).alias("content"))
    text = found.select(F.lit("report.md").alias("path"), F.lit(0).alias("rank"), F.col("address").alias("key"), F.concat("text", F.lit("\n\n")).alias("content"))
    files.save(each.unionByName(text), folder, ["rank", "key"])
