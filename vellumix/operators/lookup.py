"""Lookups: nearest ancestor, first candidate, fallback chains, references and style hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """All folders of a path, the root '' first, with their depths as positions."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def nearest_ancestor(items: DataFrame, key: str, path: str, folders: DataFrame, folder: str, value: str) -> DataFrame:
    """For each item the value of the deepest folder above it that has one (an as-of join on depth), else null."""
    climbed = items.select(key, F.posexplode(ancestors(F.col(path))).alias("depth", folder))
    found = climbed.join(folders.select(folder, value), folder, "left")
    return found.groupBy(key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("depth"))).alias(value))


def first_candidate(candidates: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first candidate of each group."""
    return candidates.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def resolve(links: DataFrame, ref: str, targets: DataFrame, ident: str, titles: list[str], missing: str = "[]") -> DataFrame:
    """links with `label`, the first title that the target has, or `missing`."""
    label = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in titles), F.lit(missing))
    return links.join(targets.select(F.col(ident).alias(ref), *titles), ref, "left").withColumn("label", label).drop(*titles)


def climb(styles: DataFrame, ident: str, parent: str, values: list[str], most: int = 9) -> DataFrame:
    """Each style with the values that it or else its nearest ancestor sets; hierarchies have at most `most` levels. A level is one join, of what isn't settled yet."""
    up = styles.select(F.col(ident).alias("__id"), F.col(parent).alias("__up"), *(F.col(v).alias(f"__{v}") for v in values))
    out = styles.withColumn("__at", F.col(parent))
    for _ in range(most - 1):
        out = out.join(up, F.col("__at") == F.col("__id"), "left")
        for v in values:
            out = out.withColumn(v, F.coalesce(v, f"__{v}"))
        out = out.withColumn("__at", F.col("__up")).drop("__id", "__up", *(f"__{v}" for v in values))
    return out.drop("__at")


def islands(df: DataFrame, keys: list[str], order: list[str], *same: str) -> DataFrame:
    """df with `island`, a number that grows whenever one of the columns differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.lag(F.lit(1)).over(w).isNull()
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
