"""Flat sequences of paragraphs or runs into nested structure: islands, look-back, look-ahead and nesting by counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import islands

__all__ = ["bridged", "coalesce_adjacent", "group_ending_with", "islands", "list_moves", "regroup", "section_moves", "set_changes", "split_at_first", "take_while"]


def window(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def take_while(df: DataFrame, keys: list[str], order: list[str], keep: Column) -> DataFrame:
    """The leading rows of each group for which `keep` holds."""
    w = window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__ok", F.min(keep.cast("int")).over(w)).filter("__ok = 1").drop("__ok")


def group_ending_with(df: DataFrame, keys: list[str], order: list[str], ends: Column) -> DataFrame:
    """df with `grp`, counted from 0: a group ends with the row for which `ends` holds."""
    w = window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("grp", F.coalesce(F.sum(ends.cast("int")).over(w), F.lit(0)))


def split_at_first(df: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """df with `after`: whether a row comes at or behind the group's first block."""
    w = window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("after", F.coalesce(F.max(block.cast("int")).over(w), F.lit(0)) == 1)


def coalesce_adjacent(df: DataFrame, keys: list[str], order: str, same: list[str], text: str) -> DataFrame:
    """Neighbours that are alike in `same` become one row, their texts one after another."""
    marked = islands(df, keys, [order], *same)
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return marked.groupBy(*keys, "island", *same).agg(F.min(order).alias(order), F.array_join(F.transform(ordered, lambda x: x[text]), "").alias(text))


def bridged(df: DataFrame, keys: list[str], order: list[str], inside: Column) -> DataFrame:
    """df with `open` and `close` of islands of `inside` that reach over a single other row when the row behind it is inside again."""
    w = window(keys, order)
    full = inside | (F.lag(inside).over(w) & F.lead(inside).over(w))
    df = df.withColumn("inside", F.coalesce(full, F.lit(False)))
    before, after = F.coalesce(F.lag("inside").over(w), F.lit(False)), F.coalesce(F.lead("inside").over(w), F.lit(False))
    return df.withColumn("open", F.col("inside") & ~before).withColumn("close", F.col("inside") & ~after)


def list_moves(df: DataFrame, keys: list[str], order: list[str], list_id: str, level: str) -> DataFrame:
    """df with `opens` and `closes`, the tags (list and item) each row begins and ends, from list and level of its neighbours. Rows outside lists have null ids."""
    w = window(keys, order)
    pid, plv, nid, nlv = F.lag(list_id).over(w), F.lag(level).over(w), F.lead(list_id).over(w), F.lead(level).over(w)
    cur, lv = F.col(list_id), F.col(level)
    fresh = pid.isNull() | (pid != cur)
    opens = F.when(cur.isNull(), 0).when(fresh, 2 * (lv + 1)).when(lv > plv, 2 * (lv - plv)).otherwise(1)
    ends = nid.isNull() | (nid != cur)
    closes = F.when(cur.isNull(), 0).when(ends, 2 * (lv + 1)).when(nlv <= lv, 2 * (lv - nlv) + 1).otherwise(0)
    return df.withColumn("opens", opens.cast("int")).withColumn("closes", closes.cast("int"))


def section_moves(df: DataFrame, keys: list[str], order: list[str], level: str) -> DataFrame:
    """Headings with `closes`, how many sections end before each."""
    before = F.lag(level).over(window(keys, order))
    return df.withColumn("closes", F.when(F.col(level) <= before, before - F.col(level) + 1).otherwise(0).cast("int"))


def set_changes(df: DataFrame, keys: list[str], order: list[str], flags: str) -> DataFrame:
    """df with `added` and `removed` formats against the row before."""
    before = F.coalesce(F.lag(flags).over(window(keys, order)), F.array().cast("array<string>"))
    return df.withColumn("added", F.array_except(flags, before)).withColumn("removed", F.array_except(before, flags))


def regroup(df: DataFrame, keys: list[str], order: list[str], title: str) -> DataFrame:
    """df with `item`: a title that comes again begins the next item."""
    return df.withColumn("item", F.row_number().over(window([*keys, title], order)))
