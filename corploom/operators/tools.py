"""The questions that a review asks of a package, and hooks to services that answer prompts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexer
from ..functions import source_text as st
from ..functions.addresses import address_key
from . import catalog, corpus, graph, registry, validation


class Explorer:
    """Read-only questions of one package; every answer is a DataFrame."""

    def __init__(self, functions: DataFrame, symbols: DataFrame, structs: DataFrame):
        self.functions, self.symbols, self.structs = functions, symbols, structs
        self.named = functions.select("address", F.col("ghidra_name").alias("name"), "code")
        self.edges = graph.call_edges(functions)
        self.catalog = catalog.build(self.named, self.edges)

    def _of(self, address: str) -> DataFrame:
        return graph.node(self.functions, address).select("address")

    def browse_functions(self, shown: str = "all", query: str = "") -> DataFrame:
        return catalog.browse(self.catalog, shown, query).select("address", catalog.row_line().alias("line"))

    def get_function_info(self, address: str) -> DataFrame:
        return catalog.detail(self.catalog, self.edges).join(self._of(address), "address", "left_semi")

    def search_code(self, needle: str, limit: int = 30) -> DataFrame:
        return corpus.search_text(self.functions, "address", "code", needle, limit)

    def read_function(self, address: str) -> DataFrame:
        return graph.node(self.functions, address).select("address", "code")

    def get_callers(self, address: str) -> DataFrame:
        near = catalog.neighbours(self.edges, self.named)
        return near.join(self._of(address).withColumnRenamed("address", "callee"), "callee", "left_semi").select("caller", "caller_name").orderBy("caller")

    def get_callees(self, address: str) -> DataFrame:
        """Known callees by name, and names that no function bears (address null)."""
        own = self._of(address)
        near = catalog.neighbours(self.edges, self.named).join(own.withColumnRenamed("address", "caller"), "caller", "left_semi").select("callee", F.col("callee_name").alias("name"))
        return near.orderBy("name")

    def get_call_sites(self, address: str, limit: int = 24) -> DataFrame:
        own = self._of(address).withColumnRenamed("address", "callee")
        return catalog.call_sites(self.named, self.edges.join(own, "callee", "left_semi"), limit)

    def get_registry(self, kind: str | None = None) -> DataFrame:
        return registry.scan(self.symbols, "symbol", kind)

    def get_structs(self) -> DataFrame:
        return self.structs.orderBy("name").select("name", registry.layout_line(F.col("name"), F.col("fields"), F.col("size")).alias("line"))

    def check_field_coherence(self, address: str) -> DataFrame:
        own = graph.node(self.functions, address).select("address", "code")
        return validation.coherence_summary(validation.field_coherence(own, self.structs))


#: Which questions and edits each role of a review may use; what a role without edits proposes is not applied (``cli.reviewed``).
READ = ("browse_functions", "get_function_info", "search_code", "read_function", "get_callers", "get_callees", "get_call_sites", "get_registry", "get_structs")
EDIT = ("unique_edits", "rewrite", "rename_symbol", "rename_struct")
ROLES = {
    "prescan": (*READ, "noise_hotspots", "with_scan"), "naming": (*READ, *EDIT, "resolve_batch"), "types": (*READ, *EDIT, "signature_audit", "indirect_candidates", "check_field_coherence"),
    "dispatch": (*READ, *EDIT, "indirect_candidates"), "syntax": (*READ, "bracket_suspects"),
}


def bracket_suspects(functions: DataFrame) -> DataFrame:
    """``address`` of texts whose brackets don't pair off: what can be told of syntax without a compiler."""

    @F.pandas_udf("boolean")
    def sound(code: pd.Series) -> pd.Series:
        return pd.Series([lexer.balanced(lexer.Tokens(c or "")) for c in code])

    return functions.where(~sound("code")).select("address")


def completions(rows: DataFrame, make: Callable[[], Callable[[str], str]], tries: int = 4, wait: float = 1.0) -> DataFrame:
    """``address, reply, error, tries`` of ``rows(address, prompt)``.

    ``make`` is called once in each task and returns the function that answers
    a prompt.  An answer that fails or is blank is asked for again, after twice
    the last wait; what still fails is a row with an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            out = []
            for address, prompt in zip(pdf["address"], pdf["prompt"]):
                reply = error = None
                for n in range(1, tries + 1):
                    try:
                        reply, error = ask(prompt), None
                        if (reply or "").strip():
                            break
                        reply, error = None, "blank answer"
                    except Exception as e:  # told in the row
                        error = f"{type(e).__name__}: {e}"
                    if n < tries:
                        time.sleep(wait * 2 ** (n - 1))
                out.append((address, reply, error, n))
            yield pd.DataFrame(out, columns=["address", "reply", "error", "tries"])

    return rows.select("address", "prompt").mapInPandas(run, "address string, reply string, error string, tries int")


SUMMARY = (
    "function_name_suggestion string, summary string, security_relevance struct<level:string,reason:string>, confirmed_behaviors array<string>, "
    "side_effects array<string>, important_strings array<string>, api_calls array<string>, confidence string"
)


def summaries(replies: DataFrame) -> DataFrame:
    """``address`` and a summary's fields of ``replies(address, reply)``; what is no JSON, even with its hex numbers quoted, is nulls."""
    return replies.select("address", st.lenient_json(F.col("reply"), SUMMARY).alias("s")).select("address", "s.*")


def by_key(functions: DataFrame, keys: DataFrame) -> DataFrame:
    """Functions of ``keys(address)`` in any spelling of the addresses, in bulk."""
    wanted = keys.select(address_key(F.col("address")).alias("_key")).distinct()
    return functions.withColumn("_key", address_key(F.col("address"))).join(wanted, "_key", "left_semi").drop("_key")
