"""Addresses: padded hex, symbol addresses and zero-stripped keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_address(value: Column) -> Column:
    """Lower-case hex without 0x, padded to 8 digits and never cut; empty if it is no hex number."""
    digits = F.lower(F.regexp_replace(F.trim(value.cast("string")), "^0[xX]", ""))
    stripped = F.regexp_replace(digits, "^0+(?=.)", "")
    padded = F.when(F.length(stripped) >= 8, stripped).otherwise(F.lpad(stripped, 8, "0"))
    return F.when(digits.rlike("^[0-9a-f]+$"), padded).otherwise("")


def symbol_address(symbol: Column, prefix: str = "FUN_") -> Column:
    """Address in a placeholder symbol such as FUN_00401000, or null."""
    digits = F.regexp_extract(symbol, f"^{prefix}([0-9a-fA-F]+)$", 1)
    return F.when(digits != "", normalize_address(digits))


def address_key(value: Column) -> Column:
    """Without 0x and leading zeros, lower case; 0 if nothing is left. Not validated."""
    digits = F.lower(F.regexp_replace(value.cast("string"), "^0[xX]", ""))
    return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))


def address_number(value: Column) -> Column:
    """The address as a number; null if it is no hex number of at most 15 digits."""
    digits = normalize_address(value)
    return F.when((digits != "") & (F.length(digits) <= 15), F.conv(digits, 16, 10).cast("long"))
