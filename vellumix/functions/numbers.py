"""Numbering, versions, lengths and dates as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN = [("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1)]
PLACES = [
    ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
    ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
]
#: English metric units of a length unit.
EMU = {"in": 914400, "cm": 360000, "mm": 36000, "pt": 12700, "px": 9525}


def roman(n: Column) -> Column:
    """Upper-case Roman numerals of 1 to 3999, else an empty string."""
    digit = lambda k: F.element_at(F.array(*map(F.lit, PLACES[k])), (F.floor(n / 10**k) % 10 + 1).cast("int"))
    whole = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(2), digit(1), digit(0))
    return F.when(n.between(1, 3999), whole).otherwise(F.lit(""))


def integer_or(c: Column, default: int | None) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def version(c: Column) -> Column:
    """struct<major, minor, patch> of 2 or 3 dotted parts, null for anything else."""
    part = lambda k: F.regexp_extract(c, "^([0-9]+)[.]([0-9]+)(?:[.]([0-9]+))?$", k)
    return F.when(c.rlike("^[0-9]+[.][0-9]+([.][0-9]+)?$"), F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), part(3).try_cast("int").alias("patch")))


def version_text(v: Column) -> Column:
    return F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), v["patch"].cast("string"))


def to_emu(length: Column) -> Column:
    """Whole English metric units of `12cm`, `3in` ...; null for other units."""
    n, unit = F.regexp_extract(length, "^([0-9]+)([a-z]+)$", 1), F.regexp_extract(length, "^([0-9]+)([a-z]+)$", 2)
    factor = F.lit(None).cast("long")
    for u, f in EMU.items():
        factor = F.when(unit == u, F.lit(f).cast("long")).otherwise(factor)
    return n.try_cast("long") * factor


def points_to_inches(points: Column) -> Column:
    return F.concat(F.floor(points / 72).cast("string"), F.lit("in"))


def pixel_width(width: Column) -> Column:
    """A bare whole number is a width in pixels; other widths stay, and none is 100%."""
    return F.when(width.try_cast("int").isNotNull(), F.concat(width, F.lit("px"))).otherwise(F.coalesce(width, F.lit("100%")))


def heading(depth: Column, most: int = 9) -> Column:
    return F.concat(F.lit("Heading"), F.least(depth, F.lit(most)).cast("string"))


def any_date(c: Column, *formats: str) -> Column:
    """The first of the formats that fits; a zone at the end is ignored."""
    bare = F.regexp_replace(c, "(?<=[0-9])(?:Z|[+-][0-9]{2}:[0-9]{2})$", "")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)).cast("date") for f in formats or ("dd/MM/yyyy", "yyyy-MM-dd")))
