"""Set operations over names and the ordered reductions beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with one shuffle: both sides are counted together."""
    both = a.distinct().withColumn("__l", F.lit(1)).unionByName(b.distinct().withColumn("__l", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.sum("__l").alias("__l")).filter("__l < 3").drop("__l")


def union_all_distinct(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Each key once, with the place where it first occurs: the parts one after another, each in its order."""
    tagged = [p.select(key, F.lit(i).alias("part"), F.col(order).alias("place")) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.min(F.struct("part", "place")).alias("first")).select(key, "first.part", "first.place")


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def joined(df: DataFrame, keys: list[str], order: str, value: str, separator: str, alias: str) -> DataFrame:
    """Values of each group as one string, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[value].cast("string")), separator).alias(alias))
