"""Catalog summaries as data: a row for each section, its content a VARIANT, merged and asked in DataFrames.

A summary is ``(section, content)``, content JSON text as prompts and files
carry it; several summaries have a group besides.  Content that is no JSON is
nothing, text behind a whole value counts for nothing; paths that lead nowhere are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import corpus

NOISE = "noise_report"
#: Keys of the noise report that a scan always sets, and those that it sets where they are missing.
ALWAYS, MISSING = ("rule_scan", "priority_files"), ("by_type", "recommendation")


def parsed(content: Column | str) -> Column:
    return F.try_parse_json(F.col(content) if isinstance(content, str) else content)


def at(content: Column, *paths: str, kind: str = "variant") -> Column:
    """What stands at the first path that leads somewhere and fits the kind."""
    return F.coalesce(*[F.try_variant_get(content, p, kind) for p in paths])


def merged(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """``group, section, content`` of ``rows(group, section, content, order)``: of each section the last one written stands.

    A partially aggregated maximum, so a group or section that holds most rows meets in no task.
    """
    return rows.groupBy(*group, "section").agg(F.max_by("content", order).alias("content"))


def _members(content: Column) -> Column:
    """An object's members as a map, without any for what is no object."""
    is_object = F.startswith(F.schema_of_variant(content), F.lit("OBJECT"))
    return F.coalesce(F.when(is_object, content.cast("map<string,variant>")), F.create_map().cast("map<string,variant>"))


def scan(counts: DataFrame, key: str, top: int = 10) -> DataFrame:
    """One row ``content``: what ``corpus.noise_counts`` come to, with the worst files first."""
    kinds = [c for c in counts.columns if c not in (key, "score", "total", "n_lines")]
    found = corpus.noise_files(counts, key, kinds)
    by_type = found.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.struct("count", "files").alias("v"))))).alias("by_type"))  # one entry a kind
    worst = corpus.noise_hotspots(counts, key, top)
    files = worst.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), (-F.col("total")).alias("b"), F.col(key).alias("file"), "score"))), lambda x: F.struct(x["file"].alias("file"), x["score"].alias("score"))).alias("priority_files"))
    whole = corpus.noise_summary(counts).crossJoin(F.broadcast(by_type)).crossJoin(F.broadcast(files))  # a row each
    return whole.select(F.to_json(F.struct(*whole.columns)).alias("content"))


def with_scan(summary: DataFrame, scanned: DataFrame) -> DataFrame:
    """The summary, its noise report brought up to date with ``scan``'s one row."""
    noise = summary.where(F.col("section") == NOISE).agg(F.max("content").alias("told"))  # one row, with or without such a section
    both = noise.crossJoin(F.broadcast(scanned.select(parsed("content").alias("scan")))).select(_members(parsed("told")).alias("old"), "scan", _members(F.col("scan")).alias("new"))
    fill = F.map_filter("new", lambda k, v: k.isin(*MISSING) & ~F.map_contains_key("old", k))
    kept = F.map_filter("old", lambda k, v: ~k.isin(*ALWAYS))
    files = F.coalesce(F.try_element_at("new", F.lit("priority_files")), F.parse_json(F.lit("[]")))
    always = F.create_map(F.lit(ALWAYS[0]), F.col("scan"), F.lit(ALWAYS[1]), files)
    report = both.select(F.lit(NOISE).alias("section"), F.to_json(F.to_variant_object(F.map_concat(fill, kept, always))).alias("content"))
    return summary.where(F.col("section") != NOISE).select("section", "content").unionByName(report)


def _items(summary: DataFrame, section: str, *paths: str) -> DataFrame:
    """``pos, item`` of the first of the section's lists that has any; items that are no objects are left out."""
    content = parsed("content")
    lists = [F.try_variant_get(content, p, "array<variant>") for p in paths]
    some = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    rows = summary.where(F.col("section") == section).select(F.posexplode(some).alias("pos", "item"))
    return rows.where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))


def priority_files(summary: DataFrame, most: int = 5) -> DataFrame:
    """``file, score, item`` of the noise report's priority files, or else its rule scan's; the first few."""
    rows = _items(summary, NOISE, "$.priority_files", "$.rule_scan.priority_files").orderBy("pos").limit(most)
    return rows.select(at(F.col("item"), "$.file", kind="string").alias("file"), at(F.col("item"), "$.score", kind="long").alias("score"), F.to_json("item").alias("item"))


def sure_placeholders(summary: DataFrame) -> DataFrame:
    """``symbol, item`` of the inventory's placeholders of high confidence."""
    rows = _items(summary, "placeholder_inventory", "$.by_priority").where(F.lower(at(F.col("item"), "$.confidence", kind="string")) == "high")
    return rows.orderBy("pos").select(at(F.col("item"), "$.symbol", "$.name", kind="string").alias("symbol"), F.to_json("item").alias("item"))
