"""Structural merge of an original document and an altered one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def revision_flags(old: DataFrame, new: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Each section of either version once: added, deleted, changed or the same, by a hash of its text. One shuffle; texts themselves stay behind."""
    mark = lambda df, side: df.select(*keys, F.lit(side).alias("s"), F.md5(F.col(text)).alias("h"))
    both = mark(old, 1).unionByName(mark(new, 2)).groupBy(*keys)
    at = lambda side: F.max(F.when(F.col("s") == side, F.coalesce("h", F.lit(""))))
    flag = F.when(at(1).isNull(), "added").when(at(2).isNull(), "deleted").when(at(1) != at(2), "changed").otherwise("same")
    return both.agg(flag.alias("flag"))


def structural_key(ancestors: Column, before: Column) -> Column:
    """How deep a section lies and how many sections precede it."""
    return F.concat_ws("_", ancestors.cast("string"), before.cast("string"))


def merge_by_key(altered: DataFrame, original: DataFrame, key: list[str], lost: list[str]) -> DataFrame:
    """The altered sections with those columns of the original section at the same place that the alteration lost."""
    back = original.select(*key, *(F.col(c).alias(f"__{c}") for c in lost))
    out = altered.join(back, key, "left")
    for c in lost:
        out = out.withColumn(c, F.coalesce(c, f"__{c}"))
    return out.drop(*(f"__{c}" for c in lost))


def translation_flags(flags: DataFrame, translated: DataFrame, keys: list[str]) -> DataFrame:
    """What a translation needs after an update: new sections to translate, changed ones to revise, deleted ones to drop."""
    todo = F.when(F.col("flag") == "added", "translate").when(F.col("flag") == "deleted", "drop").when(F.col("flag") == "changed", "revise").otherwise("keep")
    there = translated.select(*keys, F.lit(True).alias("__t")).distinct()
    return flags.join(there, keys, "left").withColumn("todo", F.when(F.col("__t").isNull() & (F.col("flag") != "deleted"), "translate").otherwise(todo)).drop("__t")
