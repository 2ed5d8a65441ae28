"""Comparison of two views of a corpus: modules, pages, images and member sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Each key of either side once, with its status: both, or the side that lacks it. Both sides are counted in one shuffle."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    status = F.when(F.max("l") + F.max("r") == 2, "both").when(F.max("l") == 1, f"missing_{names[1]}").otherwise(f"missing_{names[0]}")
    return both.groupBy(*keys).agg(status.alias("status"))


def compare_sets(left: DataFrame, right: DataFrame, keys: list[str], element: str) -> DataFrame:
    """Per key: sizes of both sets, elements that either lacks (sorted), and whether they are equal."""
    marked = reconcile(left, right, [*keys, element])
    only = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col(element)))), ",")
    return marked.groupBy(*keys).agg(
        F.count_if(F.col("status") != "missing_left").alias("n_left"),
        F.count_if(F.col("status") != "missing_right").alias("n_right"),
        only("missing_right").alias("only_left"),
        only("missing_left").alias("only_right"),
        F.every(F.col("status") == "both").alias("equal"),
    )


def roll_up(compared: DataFrame) -> DataFrame:
    """One row: pages compared, pages that differ, elements lacking on either side."""
    n = lambda c: F.sum(F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ",")))).cast("long")
    return compared.agg(F.count("*").alias("n_pages"), F.count_if(~F.col("equal")).alias("n_different"), n("only_left").alias("n_only_left"), n("only_right").alias("n_only_right"))
