"""Column functions over paths and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative(start: Column, target: Column) -> Column:
    """The way from one absolute folder to another: `..` for each step up, then the steps down; `.` if they are the same."""
    steps = lambda c: F.array_remove(F.split(c, "/"), "")
    a, b = steps(start), steps(target)
    least = F.least(F.size(a), F.size(b))
    places = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    other = F.filter(places, lambda i: F.get(a, i - 1) != F.get(b, i - 1))
    common = F.when(F.size(other) > 0, F.array_min(other) - 1).otherwise(least)
    up = F.array_repeat(F.lit(".."), F.size(a) - common)
    return F.coalesce(F.nullif(F.array_join(F.concat(up, F.slice(b, common + 1, F.size(b))), "/"), F.lit("")), F.lit("."))


def title_version(text: Column, product: str) -> Column:
    """What the first title says beside the product's name."""
    title = F.regexp_extract(text, "<(?:db:)?title>([^<]*)</", 1)
    return F.trim(F.replace(title, F.lit(product), F.lit("")))
