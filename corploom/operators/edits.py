"""Edits of a corpus: substitutions with counts, unique edits, batches of names, reviews."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.source_text import stripped
from .registry import KINDS, replace_symbols
from .validation import is_identifier


def substitute(corpus: DataFrame, text: str, pattern: str, replacement: str) -> DataFrame:
    """The corpus with every match replaced, and ``hits`` for each text."""
    hits = F.regexp_count(F.col(text), F.lit(pattern)).cast("long")
    return corpus.withColumn("hits", F.coalesce(hits, F.lit(0))).withColumn(text, F.regexp_replace(text, pattern, replacement))


def substitution_totals(substituted: DataFrame) -> DataFrame:
    """One row: occurrences, and texts that had any."""
    return substituted.agg(F.sum("hits").alias("occurrences"), F.count_if(F.col("hits") > 0).alias("texts"))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, side by side; 0 for an empty part."""
    size = F.length(part)
    return F.when(size == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.greatest(size, F.lit(1))).cast("int"))


def unique_edits(corpus: DataFrame, edits: DataFrame) -> DataFrame:
    """``address, code, status``: ``edits(address, old, new)``, at most one an address, applied where ``old`` stands exactly once."""
    met = corpus.select("address", "code").join(edits, "address")
    n = occurrences(F.col("code"), F.col("old"))
    status = F.when(n == 1, "edited").when(n == 0, "missing").otherwise("ambiguous")
    return met.withColumn("status", status).withColumn("code", F.when(F.col("status") == "edited", F.replace("code", F.col("old"), F.col("new"))).otherwise(F.col("code"))).select("address", "code", "status")


def resolve_batch(resolutions: DataFrame, symbols: DataFrame) -> DataFrame:
    """``status`` of ``resolutions(symbol, canonical_name, kind)`` against the registry: invalid, same, conflict or applied; an unknown kind is a function."""
    known = symbols.select("symbol", F.col("canonical_name").alias("_known"))
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("function")
    met = resolutions.withColumns({"symbol": stripped(F.coalesce("symbol", F.lit(""))), "canonical_name": stripped(F.coalesce("canonical_name", F.lit(""))), "kind": kind}).join(known, "symbol", "left")
    valid = (F.col("symbol") != "") & is_identifier(F.col("canonical_name"))
    status = F.when(~valid, "invalid").when(F.col("_known") == F.col("canonical_name"), "same").when(F.col("_known").isNotNull(), "conflict").otherwise("applied")
    return met.withColumn("status", status).drop("_known")


def apply_batch(corpus: DataFrame, text: str, resolved: DataFrame, key: str = "address") -> DataFrame:
    """The corpus with every applied symbol replaced by its name, whole words only: ``key, text, hits``."""
    mapping = resolved.where("status = 'applied'").groupBy(F.col("symbol").alias("old")).agg(F.min("canonical_name").alias("new"))
    return replace_symbols(corpus, key, text, mapping)


def rename_symbol(corpus: DataFrame, text: str, old: str, new: str) -> DataFrame:
    """An identifier renamed everywhere, whole words only; a new name that is no identifier is an error."""
    if not re.fullmatch(r"[A-Za-z_]\w*", new):
        raise ValueError(f"{new!r} is no identifier")
    return substitute(corpus, text, rf"\b\Q{old}\E\b", new)


def rewrite(corpus: DataFrame, rewrites: DataFrame, prologue: str = "") -> DataFrame:
    """The corpus with the whole text of ``rewrites(address, code)`` in place of the old one, the prologue before it unless it is there, a line end behind it."""
    code = F.col("_new")
    body = F.when(F.lit(prologue == "") | F.contains(code, F.lit(prologue.strip() or " ")), code).otherwise(F.concat(F.lit(prologue), F.regexp_replace(code, r"^\s+", "")))
    ended = F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
    met = corpus.join(rewrites.select("address", F.col("code").alias("_new")), "address", "left")
    return met.withColumn("code", F.when(code.isNotNull(), ended).otherwise(F.col("code"))).select(*corpus.columns)


def change_totals(changes: DataFrame) -> DataFrame:
    """``tool, changes, addresses`` of a review's ``changes(agent, tool, address)``."""
    return changes.groupBy("tool").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("address").alias("addresses"))


def changes_by_agent(changes: DataFrame) -> DataFrame:
    """``agent, changes`` of ``changes(seq, agent, tool, address)``; changes without an agent are left out."""
    return changes.where("coalesce(agent, '') <> ''").groupBy("agent").agg(F.count(F.lit(1)).alias("changes"))


def review_log(changes: DataFrame) -> DataFrame:
    """One JSON object a change, in order."""
    return changes.orderBy("seq").select(F.to_json(F.struct(*changes.columns)).alias("line"))


def rename_struct(corpus: DataFrame, text: str, old: str, new: str) -> DataFrame:
    """Struct tags and their uses, whole words only."""
    return substitute(corpus, text, rf"\bstruct\s+\Q{old}\E\b", f"struct {new}")


def rename_layout(structs: DataFrame, old: str, new: str) -> DataFrame:
    """The registry with one struct under another name; if that name is taken its own layout stays and the old one goes."""
    taken = not structs.where(F.col("name") == new).isEmpty()
    if taken or old == new:
        return structs.where(F.col("name") != old) if old != new else structs
    return structs.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name")))
