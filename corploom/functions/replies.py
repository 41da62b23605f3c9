"""Parsers of tagged replies: columns in, structs out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .source_text import canonical_field_names, json_list, let, tagged_block, tagged_text, without_fence

#: Tags that a reply may hold.
TAGS = ("structured", "struct_updates", "named", "naming_map", "registry_updates", "skip")

_FIELD = "offset:string,name:string,type:string,size:string"
STRUCT_UPDATE = f"name string, fields array<struct<{_FIELD}>>, size string, confidence string, evidence string"
NAME_UPDATE = "symbol string, canonical_name string, kind string, confidence string, evidence string, inferred_type string, value string"


def struct_updates(text: Column) -> Column:
    """Proposals of layouts; numbers may come as text, and what is no number is null."""
    raw = json_list(text, STRUCT_UPDATE)
    whole = lambda c: F.when(c.rlike(r"^\s*[-+]?\d{1,18}\s*$"), F.trim(c).cast("long"))
    return F.transform(raw, lambda u: F.struct(
        u["name"].alias("name"), whole(u["size"]).alias("size"), u["confidence"].alias("confidence"), u["evidence"].alias("evidence"),
        F.transform(F.coalesce(u["fields"], F.array().cast(f"array<struct<{_FIELD}>>")), lambda f: F.struct(whole(f["offset"]).alias("offset"), f["name"].alias("name"), f["type"].alias("type"), whole(f["size"]).alias("size"))).alias("fields"),
    ))


def structure_reply(text: Column) -> Column:
    """``struct(structured, updates, skip)``; without the tag the whole reply is the text, unless it gives a reason to skip."""
    parts = F.struct(canonical_field_names(tagged_block(text, "structured", TAGS)).alias("t"), tagged_text(text, "skip", TAGS).alias("r"), text.alias("all"))

    def told(p: Column) -> Column:
        skip = F.when(p["t"] == "", p["r"]).otherwise("")
        structured = F.when(p["t"] != "", p["t"]).when(p["r"] != "", "").otherwise(canonical_field_names(without_fence(p["all"])))
        updates = struct_updates(F.when(skip == "", tagged_text(p["all"], "struct_updates", TAGS)).otherwise(""))
        return F.struct(structured.alias("structured"), updates.alias("updates"), skip.alias("skip"))

    return let(parts, told)


def naming_reply(text: Column) -> Column:
    """``struct(named, naming_map, updates)``."""
    return F.struct(
        canonical_field_names(tagged_block(text, "named", TAGS)).alias("named"), tagged_text(text, "naming_map", TAGS).alias("naming_map"),
        json_list(tagged_text(text, "registry_updates", TAGS), NAME_UPDATE).alias("updates"),
    )
