"""Operators over a corpus of per-function source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import source_text as st
from ..functions.addresses import address_number
from ..storage import Scratch


def drop_runtime_stubs(functions: DataFrame, name: str = "ghidra_name") -> DataFrame:
    return functions.where(~st.is_runtime_stub(F.col(name)))


def noise_counts(docs: DataFrame, key: str, text: str, patterns: dict[str, tuple[str, int]] = st.NOISE) -> DataFrame:
    """``key``, a count for each pattern, ``score`` (weighted), ``total`` and ``n_lines``; one pass over the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    counts = [F.regexp_count(body, F.lit(rx)).cast("long").alias(k) for k, (rx, _) in patterns.items()]
    n_lines = (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long")
    got = docs.select(F.col(key), *counts, n_lines.alias("n_lines"))
    score = sum((F.col(k) * w for k, (_, w) in patterns.items()), F.lit(0))
    return got.withColumn("score", score.cast("long")).withColumn("total", sum((F.col(k) for k in patterns), F.lit(0)).cast("long"))


def select_functions(functions: DataFrame, name: str = "ghidra_name") -> tuple[DataFrame, DataFrame]:
    """The functions without runtime stubs, and one row: how many there were, and how many went.

    The rows are written once and counted on the way; the one row is there when
    this returns, without a second scan.
    """
    spark, seen = functions.sparkSession, Observation()
    stub = st.is_runtime_stub(F.col(name))
    counted = functions.observe(seen, F.count(F.lit(1)).alias("raw"), F.count_if(stub).alias("runtime"))
    kept = Scratch(spark, "functions").save(counted.where(~stub))
    return kept, spark.createDataFrame([(seen.get["raw"], seen.get["runtime"])], "raw long, runtime long")


def noise_files(counts: DataFrame, key: str, kinds: list[str], most: int = 8) -> DataFrame:
    """``kind, count, files``: totals of each kind that occurs, and the first ``most`` texts that have it, as name (n)."""
    parts = ", ".join(f"'{k}', `{k}`" for k in kinds)
    tall = counts.select(F.col(key), F.expr(f"stack({len(kinds)}, {parts}) as (kind, n)")).where("n > 0")
    first = tall.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(key))).where(F.col("place") <= most)
    named = first.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("place", F.format_string("%s (%d)", F.col(key).cast("string"), "n").alias("f"))))["f"].alias("files"))
    return tall.groupBy("kind").agg(F.sum("n").alias("count")).join(named, "kind")


def noise_summary(counts: DataFrame) -> DataFrame:
    """One row: texts scanned, texts with noise, and the score of all."""
    return counts.agg(F.count(F.lit(1)).alias("files_scanned"), F.count_if(F.col("score") > 0).alias("files_with_noise"), F.coalesce(F.sum("score"), F.lit(0)).alias("total_score"))


def hotspot_lines(hotspots: DataFrame, key: str, kinds: list[str], most: int = 5) -> DataFrame:
    """``line`` of the first few hotspots: address, score, name and the kinds that occur."""
    said = F.array_join(F.array_compact(F.array(*[F.when(F.col(k) > 0, F.format_string(k.replace("%", "%%") + "=%d", k)) for k in kinds])), ",")
    name = F.col(key).cast("string")
    address = F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1)).otherwise("?")
    order = [F.desc("score"), F.desc("total"), F.col(key)]
    return hotspots.orderBy(*order).limit(most).select(F.format_string("- %s  score=%d  %s  (%s)", address, "score", name, said).alias("line"))


#: What is counted before and after a reconstruction.
REGRESSION_PATTERNS = {
    "goto": r"\bgoto\b", "LAB_": r"\bLAB_\w+", "iVar/uVar": r"\b[iu]Var\d+\b", "undefined*": r"\bundefined\d*\b",
    "local_*/acStack_*": r"\b(?:local_[0-9a-f]{3,}|a[cifu]Stack_[0-9a-f]+)\b", "w_var*": r"\bw_var\d+\b", "tmp_*": r"\btmp_[a-z]\b",
    "hex >= 3 digits": r"\b0x[0-9a-fA-F]{3,}\b", "bare ptr cast": r"\*\(\w+\s*\*\)\s*\(\s*\(int\s*\)", "word-by-word copy": r"\*\(\s*uint32_t\s*\*\).*src.*dst",
}


def regression_metrics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pattern, n`` of the ten regression patterns, the most frequent of each text first."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count(body, F.lit(rx)).cast("long").alias("n")) for k, rx in REGRESSION_PATTERNS.items()])
    return docs.select(F.col(key), F.explode(rows).alias("x")).select(key, "x.pattern", "x.n").orderBy(key, F.desc("n"), "pattern")


def noise_hotspots(counts: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The ``top`` (1 to 30) noisiest: by score, then by number of hits, then by key."""
    return counts.where("score > 0").orderBy(F.desc("score"), F.desc("total"), key).limit(max(1, min(30, top)))


def noise_by_type(counts: DataFrame, kinds: list[str]) -> DataFrame:
    """``kind, hits, files``: totals of each kind over the corpus."""
    parts = ", ".join(f"'{k}', `{k}`" for k in kinds)
    tall = counts.select(F.expr(f"stack({len(kinds)}, {parts}) as (kind, n)"))
    return tall.groupBy("kind").agg(F.sum("n").alias("hits"), F.count_if(F.col("n") > 0).alias("files"))


def search_text(docs: DataFrame, key: str, text: str, needle: str, limit: int = 30, width: int = 240) -> DataFrame:
    """Lines that hold ``needle``, whatever the case, in order of key and line; the first ``limit``."""
    # the cheap test of the whole text comes first, so only texts with a hit are cut into lines
    hit = docs.where(F.contains(F.lower(text), F.lit(needle.lower())))
    cut = hit.select(F.col(key), F.posexplode(st.lines(F.col(text))).alias("pos", "line"))
    found = cut.where(F.contains(F.lower("line"), F.lit(needle.lower())))
    return found.select(key, (F.col("pos") + 1).cast("long").alias("line_no"), st.stripped(F.col("line")).substr(1, width).alias("snippet")).orderBy(key, "line_no").limit(limit)


def browse(catalog: DataFrame, shown: Column, query: str, fields: list[str]) -> DataFrame:
    """Rows that pass the filter and hold ``query`` in one of the fields, whatever the case."""
    needle = F.lit(query.lower())
    held = F.lit(False)
    for f in fields:
        held = held | F.contains(F.lower(F.col(f)), needle)
    return catalog.where(shown & (held if query else F.lit(True)))


def fingerprint_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``fingerprint, n, first_key`` of texts that share their structure."""
    prints = docs.select(F.col(key), st.fingerprint(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).where("n > 1")


def drop_overlapping(rows: DataFrame, key: str, refs: str, fingerprint: str, gap: int = 16) -> DataFrame:
    """One entry of neighbours at most ``gap`` apart: ``key, dropped, reason, kept`` (the neighbour that an entry went for).

    Neighbours are taken in order.  If one side only is referenced, the other
    goes; if none is and the fingerprints agree, the upper goes; a pair with an
    entry that went already is passed over.  Runs of close neighbours are
    islands, and each island is folded by itself; only the gap to the previous
    key, not the fold, needs the order of all rows, so keys are cut into ranges
    whose borders overlap by nothing: an island that crosses a border is found
    by its shared start.
    """
    islands = _islands(rows.select(F.col(key).alias("k"), F.col(refs).alias("r"), F.col(fingerprint).alias("f")), gap)
    entries = islands.groupBy("island").agg(F.array_sort(F.collect_list(F.struct("k", "r", "f"))).alias("e"))  # close neighbours only
    start = F.struct(F.element_at("e", 1).alias("last"), F.lit(False).alias("gone"), F.expr("array_repeat(named_struct('k', e[0].k, 'dropped', false, 'reason', '', 'kept', cast(null as long)), 1)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["last"]
        lower = (a["r"] == 0) & (x["r"] > 0) & ~acc["gone"]
        upper = ((a["r"] > 0) & (x["r"] == 0) | (a["r"] == 0) & (x["r"] == 0) & (a["f"] == x["f"])) & ~acc["gone"]
        upper = F.coalesce(upper, F.lit(False))
        why = F.when(upper & (a["r"] > 0), "callsite").when(upper, "fingerprint").otherwise("")
        head = F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1)
        old = F.element_at(acc["out"], -1)
        old = F.when(lower, F.struct(old["k"].alias("k"), F.lit(True).alias("dropped"), F.lit("callsite").alias("reason"), x["k"].alias("kept"))).otherwise(old)
        new = F.struct(x["k"].alias("k"), upper.alias("dropped"), why.alias("reason"), F.when(upper, a["k"]).alias("kept"))
        return F.struct(x.alias("last"), upper.alias("gone"), F.concat(head, F.array(old), F.array(new)).alias("out"))

    folded = entries.select(F.explode(F.aggregate(F.slice("e", F.lit(2), F.size("e")), start, step, lambda acc: acc["out"])).alias("x"))
    return folded.select(F.col("x.k").alias(key), "x.dropped", "x.reason", "x.kept")


def overlap_report(functions: DataFrame, gap: int = 16) -> DataFrame:
    """``kept, dropped, gap, kept_name, dropped_name, kept_callers, dropped_callers, reason`` of ``functions(address, ghidra_name, code)``.

    Callers are counted by name: functions of another name that mention it before a bracket.
    """
    from .graph import call_edges

    counts = call_edges(functions, by_name=True).groupBy(F.col("callee_name").alias("ghidra_name")).agg(F.count_distinct("caller").alias("refs"))
    rows = functions.join(counts, "ghidra_name", "left").select(
        "address", "ghidra_name", F.coalesce("refs", F.lit(0)).alias("refs"), address_number(F.col("address")).alias("n"), st.fingerprint(F.coalesce("code", F.lit(""))).alias("print")
    )
    gone = drop_overlapping(rows.where("n is not null"), "n", "refs", "print", gap).where("dropped")
    side = lambda who: rows.select(F.col("n").alias(who + "_n"), F.col("address").alias(who), F.col("ghidra_name").alias(who + "_name"), F.col("refs").alias(who + "_callers"))
    met = gone.select(F.col("n").alias("dropped_n"), F.col("kept").alias("kept_n"), "reason").join(side("dropped"), "dropped_n").join(side("kept"), "kept_n")
    return met.select("kept", "dropped", F.abs(F.col("dropped_n") - F.col("kept_n")).alias("gap"), "kept_name", "dropped_name", "kept_callers", "dropped_callers", "reason")


def without_overlaps(functions: DataFrame, gap: int = 16) -> DataFrame:
    return functions.join(overlap_report(functions, gap).select(F.col("dropped").alias("address")), "address", "left_anti")


def _islands(rows: DataFrame, gap: int, span: int = 1 << 16) -> DataFrame:
    """``island``: the first key of each run of keys at most ``gap`` apart.

    Windows run inside ranges of ``span`` keys.  A second, far smaller window
    over one row for each range joins islands that touch across borders.
    """
    ranged = rows.withColumn("range", F.floor(F.col("k") / span))
    w = Window.partitionBy("range").orderBy("k")
    marked = ranged.withColumn("new", F.coalesce((F.col("k") - F.lag("k").over(w) > gap), F.lit(True)))
    marked = marked.withColumn("local", F.last(F.when(F.col("new"), F.col("k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy("range").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max("local").alias("tail"), F.min("local").alias("head"))
    # a chain of ranges joined end to end begins where the previous range's last key is out of reach
    by_range = Window.orderBy("range")
    ends = ends.withColumn("joined", F.coalesce(F.col("low") - F.lag("high").over(by_range) <= gap, F.lit(False)))
    ends = ends.withColumn("own", F.when(~F.col("joined") | (F.col("tail") != F.col("head")), F.col("tail")))
    ends = ends.withColumn("before", F.last("own", ignorenulls=True).over(by_range.rowsBetween(Window.unboundedPreceding, -1)))
    fix = ends.select("range", F.col("head").alias("h"), F.when(F.col("joined"), F.col("before")).alias("to"))
    return marked.join(fix, "range").select("k", "r", "f", F.coalesce(F.when(F.col("local") == F.col("h"), F.col("to")), F.col("local")).alias("island"))


def successor_pairs(rows: DataFrame, group: str, order: str, key: str, gap: Column) -> DataFrame:
    """Neighbours within a group: ``group, key, next_key`` where ``gap`` (over ``here`` and ``there``) holds."""
    w = Window.partitionBy(group).orderBy(order, key)
    near = rows.select(group, F.col(key), F.col(order).alias("here"), F.lead(order).over(w).alias("there"), F.lead(key).over(w).alias("next_key"))
    return near.where(gap).select(group, key, "next_key")


def context_windows(rows: DataFrame, group: str, order: str, flag: Column, value: str, reach: int = 5) -> DataFrame:
    """Flagged rows with the values of up to ``reach`` rows on either side, in order."""
    w = Window.partitionBy(group).orderBy(order)
    around = F.concat_ws(",", F.collect_list(F.col(value).cast("string")).over(w.rowsBetween(-reach, reach)))
    return rows.withColumn("context", around).where(flag)


def text_around(code: Column, line_no: Column, before: int = 5, after: int = 5, most: int = 1600) -> Column:
    """The lines round one, numbered, as a text of ``most`` characters at most, with a mark where it is cut."""
    text = st.lines(code)
    at = F.greatest(F.lit(1), F.least(line_no, F.size(text)))
    first = F.greatest(F.lit(1), at - before)
    shown = F.transform(F.slice(text, first, F.least(F.size(text), at + after) - first + 1), lambda x, k: F.format_string("L%d: %s", first + k, x))
    whole = F.array_join(shown, "\n")
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.rtrim(whole.substr(1, most)), F.lit("\n...(context window truncated)")))


def pick_facts(facts: DataFrame, group: str, snippet: str, order: list[Column], take: int) -> DataFrame:
    """The first ``take`` facts of each group with distinct snippets; ``place`` counts them."""
    by_snippet = Window.partitionBy(group, snippet).orderBy(*order)
    once = facts.withColumn("_n", F.row_number().over(by_snippet)).where("_n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("place") <= take).drop("_n")
