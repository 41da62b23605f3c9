"""The function catalog and the read-only questions asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import source_text as st
from . import graph

#: Named filters of ``browse``; any other name shows all.
FILTERS = {
    "entries": "is_entry",
    "placeholders": "size(placeholders) > 0",
    "indirect": "size(indirect_sites) > 0",
    "isolated": "n_callers = 0 and n_callees = 0",
    "no_callers": "n_callers = 0",
}


def build(functions: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row for each of ``functions(address, name, code)``.

    ``is_entry`` asks whether the name is called anywhere, ``n_callers`` counts
    callers of the address; with repeated names the two may differ.
    """
    if edges is None:
        edges = graph.call_edges(functions.withColumnRenamed("name", "ghidra_name"))
    ins = edges.groupBy(F.col("callee").alias("address")).agg(F.count_distinct("caller").alias("n_callers"))
    outs = edges.groupBy(F.col("caller").alias("address")).agg(F.count_distinct("callee").alias("n_callees"))
    called = edges.select(F.col("callee_name").alias("name"), F.lit(True).alias("_called")).distinct()
    code = F.col("code")
    rows = functions.join(ins, "address", "left").join(outs, "address", "left").join(called, "name", "left").withColumn("d", st.definition(code))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "address", "name", F.coalesce("d.return_type", F.lit("?")).alias("return_type"), st.as_list(F.col("d.params")).alias("params"),
        F.coalesce("d.signature", "name").alias("signature"), zero("n_callers"), zero("n_callees"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("code", F.lit(st.PLACEHOLDER), F.lit(0)))).alias("placeholders"),
        st.indirect_calls(code).alias("indirect_sites"), F.size(st.lines(code)).alias("n_lines"), st.body_preview(code).alias("preview"), F.col("_called").isNull().alias("is_entry"),
    )


def browse(catalog: DataFrame, shown: str = "all", query: str = "") -> DataFrame:
    """Rows of a named filter that hold ``query`` in name, address, signature or a placeholder, whatever the case."""
    q = F.lit(query.lower())
    held = F.contains(F.lower("name"), q) | F.contains("address", q) | F.contains(F.lower("signature"), q) | F.exists("placeholders", lambda p: F.contains(F.lower(p), q))
    return catalog.where(F.expr(FILTERS.get(shown, "true")) & (held if query else F.lit(True))).orderBy("address")


def call_sites(functions: DataFrame, edges: DataFrame, limit: int = 24, width: int = 240) -> DataFrame:
    """``callee, caller, line_no, snippet``: lines with ``name(`` in callers, the first ``limit`` of each callee.

    The names called on each line meet the edges in a sort-merge join, never by
    broadcast: Spark takes lines cut from text for as small as the table they came from.
    """
    lines = functions.select(F.col("address").alias("caller"), F.posexplode(st.lines(F.col("code"))).alias("pos", "line"))
    named = lines.select("caller", "pos", st.stripped(F.col("line")).substr(1, width).alias("snippet"), F.explode(graph.called_names(F.col("line"))).alias("callee_name"))
    met = edges.select("caller", "callee", "callee_name").join(named.hint("merge"), ["caller", "callee_name"])
    w = Window.partitionBy("callee").orderBy("caller", "pos")
    return met.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).select("callee", "caller", (F.col("pos") + 1).alias("line_no"), "snippet")


def neighbours(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """``caller, caller_name, callee, callee_name`` of all edges: callers and callees of every function at once."""
    named = lambda who: functions.select(F.col("address").alias(who), F.col("name").alias(who + "_name"))
    return edges.select("caller", "callee").distinct().join(named("caller").hint("merge"), "caller").join(named("callee").hint("merge"), "callee").select("caller", "caller_name", "callee", "callee_name")


def callers(edges: DataFrame, address: str) -> DataFrame:
    return edges.where(F.col("callee") == address).select("caller").distinct().orderBy("caller")


def callees(edges: DataFrame, address: str) -> DataFrame:
    return edges.where(F.col("caller") == address).select("callee", "callee_name").distinct().orderBy("callee_name")


def indirect_candidates(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, suspect, named_line, switches, table_line, confirmed, signature_fits`` of ``pairs(source, suspect)`` addresses.

    Confirmed is an edge whose suspect's name stands on a line with a bracket
    and one of ``= , { [``, or, failing that, whose source calls through a
    table; signatures fit if they have as many parameters, or the source has
    one at most.
    """
    shape = functions.select("address", "name", "code", F.size(st.as_list(st.definition(F.col("code"))["params"])).alias("n"))
    source = shape.select(F.col("address").alias("source"), "code", F.col("n").alias("n_source"))
    other = shape.select(F.col("address").alias("suspect"), F.col("name").alias("suspect_name"), F.col("n").alias("n_suspect"))
    met = pairs.select("source", "suspect").distinct().join(source, "source").join(other, "suspect")
    text = st.lines(F.col("code"))
    met = met.withColumns({
        "named_line": F.try_element_at(F.filter(F.transform(text, lambda x, k: F.when(F.contains(x, F.col("suspect_name")) & x.contains("(") & x.rlike(r"[=,{\[]"), k + 1)), lambda k: k.isNotNull()), F.lit(1)),
        "table_line": F.try_element_at(F.filter(F.transform(text, lambda x, k: F.when(x.rlike(r"\[\s*\w+\s*\]\s*\("), k + 1)), lambda k: k.isNotNull()), F.lit(1)),
        "switches": F.size(F.filter(text, lambda x: x.contains("case ") | x.contains("switch "))),
    })
    return met.select(
        "source", "suspect", F.contains("code", "suspect_name").alias("named"), "named_line", "switches", F.when(F.col("named_line").isNull(), F.col("table_line")).alias("table_line"),
        (F.col("named_line").isNotNull() | F.col("table_line").isNotNull()).alias("confirmed"), ((F.col("n_source") == F.col("n_suspect")) | (F.col("n_source") <= 1)).alias("signature_fits"),
    )


_LABEL, _GOTO = r"^\s*(LAB_[A-Za-z0-9_]+):\s*$", r"\bgoto\s+(LAB_[A-Za-z0-9_]+)\s*;"


def goto_tails(functions: DataFrame, most: int = 8, height: int = 10) -> DataFrame:
    """``address, place, label, line_no, body, cut``: text behind each label that a goto names, up to the next label.

    Labels are LAB_ names alone on their line; of one that stands twice the
    last is meant; the first ``most`` in order of their first goto; ``cut``
    tells whether the text goes on.  A fold over each text's own lines.
    """
    text = st.lines(F.col("code"))
    labels = F.filter(F.transform(text, lambda x, k: F.struct(k.alias("at"), F.regexp_extract(x, _LABEL, 1).alias("name"))), lambda x: x["name"] != "")
    aimed = F.array_distinct(F.regexp_extract_all("code", F.lit(_GOTO), F.lit(1)))
    rows = functions.select("address", text.alias("text"), labels.alias("labels"), aimed.alias("aimed"))
    known = F.filter("aimed", lambda g: F.exists("labels", lambda x: x["name"] == g))
    rows = rows.select("address", "text", "labels", F.posexplode(F.slice(known, 1, most)).alias("place", "label"))
    rows = rows.withColumn("at", F.array_max(F.transform(F.filter("labels", lambda x: x["name"] == F.col("label")), lambda x: x["at"])))
    rows = rows.withColumn("stop", F.coalesce(F.array_min(F.filter(F.transform("labels", lambda x: x["at"]), lambda a: a > F.col("at"))), F.size("text")))
    size = F.least(F.col("stop") - F.col("at"), F.lit(height))
    return rows.select("address", "place", "label", (F.col("at") + 1).alias("line_no"), F.array_join(F.slice("text", F.col("at") + 1, size), "\n").alias("body"), (F.col("stop") > F.col("at") + size).alias("cut"))


#: Operations that bear on layout, and what in the C text makes them worth a look.
PCODE_OPERATIONS = r"\b(?:LOAD|STORE|PTRSUB|PTRADD|INT_ADD|CAST|CALL)\b"
OFFSET_ACCESS = r"\*\s*\([^)]*\*\s*\)\s*\([^;\n]*\+\s*(?:0x[0-9a-fA-F]+|\d+)\s*\)"
HEX_INDEX = r"\b[A-Za-z_]\w*\s*\[\s*0x[0-9a-fA-F]+\s*\]"


def relevant_pcode(pcode: Column, code: Column, most: int = 6000) -> Column:
    """Lines of the seven operations that bear on layout, where the C text has an offset access or there is none; a column."""
    kept = F.filter(F.transform(F.split(pcode, "\n"), st.stripped), lambda x: x.rlike(PCODE_OPERATIONS))
    text = F.array_join(kept, "\n")
    cut = F.when(F.length(text) > most, F.concat(text.substr(1, most), F.lit("\n...(truncated)"))).otherwise(text)
    bare = F.coalesce(code, F.lit(""))
    return F.when((bare == "") | bare.rlike(OFFSET_ACCESS) | bare.rlike(HEX_INDEX), F.coalesce(cut, F.lit(""))).otherwise("")


def row_line() -> Column:
    """A catalog row on one line."""
    size = lambda c: F.size(F.col(c))
    flags = F.array_compact(F.array(
        F.when(F.col("is_entry"), "entry"), F.when(size("placeholders") > 0, F.format_string("ph:%d", size("placeholders"))),
        F.when(size("indirect_sites") > 0, F.format_string("indirect:%d", size("indirect_sites"))), F.when((F.col("n_callers") == 0) & ~F.col("is_entry"), "no_callers"),
    ))
    params = F.when(size("params") > 0, F.array_join("params", ", ")).otherwise("void")
    shown = F.when(F.size(flags) > 0, F.array_join(flags, ",")).otherwise("-")
    return F.format_string("0x%s | %s | %s | (%s) | callers:%d callees:%d | %s", "address", "name", "return_type", params, "n_callers", "n_callees", shown)


def with_naming_maps(catalog: DataFrame, maps: DataFrame, most: int = 800) -> DataFrame:
    """The catalog with ``naming_map`` of ``maps(address, naming_map)``, cut where it is long, empty where there is none."""
    text = st.stripped(F.col("naming_map"))
    cut = F.when(F.length(text) > most, F.concat(text.substr(1, most), F.lit("\n...(truncated)"))).otherwise(text)
    return catalog.join(maps.select("address", cut.alias("naming_map")), "address", "left").withColumn("naming_map", F.coalesce("naming_map", F.lit("")))


def detail(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """``address, text``: all that the catalog knows of each function, a line for each thing."""
    near = neighbours(edges, catalog)
    shown = lambda who: F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.col(who + "_name").alias("n"), F.col(who).alias("a")))), lambda x: F.format_string("%s(0x%s)", x["n"], x["a"])), ", ")
    ins, outs = near.groupBy(F.col("callee").alias("address")).agg(shown("caller").alias("ins")), near.groupBy(F.col("caller").alias("address")).agg(shown("callee").alias("outs"))
    rows = catalog.join(ins, "address", "left").join(outs, "address", "left")
    params = F.when(F.size("params") > 0, F.array_join("params", ", ")).otherwise("void")
    sites = F.array_join(F.transform("indirect_sites", lambda x: F.format_string("  L%d: %s", x["line"], x["snippet"])), "\n")
    text = F.concat_ws(
        "\n", F.concat(F.lit("address: 0x"), "address"), F.concat(F.lit("name: "), "name"), F.concat(F.lit("signature: "), "signature"), F.concat(F.lit("return: "), "return_type"),
        F.concat(F.lit("params: "), params), F.format_string("lines: %d", "n_lines"), F.format_string("callers: %d  callees: %d  entry: %s", "n_callers", "n_callees", F.col("is_entry").cast("string")),
        F.when(F.size("placeholders") > 0, F.concat(F.lit("placeholders: "), F.array_join("placeholders", ", "))), F.when(F.size("indirect_sites") > 0, F.concat(F.lit("indirect calls:\n"), sites)),
        F.concat(F.lit("resolved callees: "), "outs"), F.concat(F.lit("callers: "), "ins"),
        F.when(F.col("ins").isNull() & ~F.col("is_entry"), "callers: none known; it may be called through a pointer or a table"),
        F.when(F.col("preview") != "", F.concat(F.lit("body preview:\n"), "preview")),
    )
    return rows.select("address", text.alias("text"))


def review_context(catalog: DataFrame, most: int = 50, entries: int = 20) -> dict[str, DataFrame]:
    """``totals`` (one row), the first ``notable`` rows (placeholders or indirect calls) and the first ``entries``."""
    notable = (F.size("placeholders") > 0) | (F.size("indirect_sites") > 0)
    return {
        "totals": catalog.agg(F.count(F.lit(1)).alias("functions"), F.sum(F.size("placeholders")).alias("placeholders"), F.sum(F.size("indirect_sites")).alias("indirect_sites")),
        "notable": catalog.where(notable).orderBy("address").limit(most).select("address", row_line().alias("line")),
        "entries": catalog.where("is_entry").orderBy("address").limit(entries).select("address", "name"),
    }
