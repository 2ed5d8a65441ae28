"""Ordered trees as a table of nodes, and the axes of tree queries as joins and windows.

A node has doc_id, pre and post (the order in which it begins and ends), parent (the parent's pre), depth, sib (its place among its
siblings), kind (elem, text, pi), ns, qname, local, attrs and text. All axes stay within a document, so tables that are
partitioned by doc_id need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "doc_id long, pre int, post int, parent int, depth int, sib int, kind string, ns string, qname string, local string, attrs map<string,string>, text string"


def _other(nodes: DataFrame, prefix: str, *cols: str) -> DataFrame:
    return nodes.select(F.col("doc_id"), *(F.col(c).alias(f"{prefix}_{c}") for c in cols))


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes whose parent is in `of` (doc_id, pre)."""
    return nodes.join(of.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"], "left_semi").select(nodes.columns)


def parents(nodes: DataFrame, *cols: str) -> DataFrame:
    """Every node with columns of its parent, named parent_...; null for roots."""
    up = _other(nodes, "parent", "pre", *cols).withColumnRenamed("parent_pre", "parent")
    return nodes.join(up, ["doc_id", "parent"], "left")


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs of a node of `of` (as top) and each node below it: begins later and ends earlier."""
    top = _other(of, "top", "pre", "post")
    return nodes.join(top, "doc_id").filter("pre > top_pre AND post < top_post")


def inside(nodes: DataFrame, top: Column) -> DataFrame:
    """Every node with `inside`: whether it has an ancestor for which `top` holds. One window over the document instead of a range join."""
    w = Window.partitionBy("doc_id").orderBy("pre")
    ends = F.max(F.when(top, F.col("post"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return nodes.withColumn("inside", F.coalesce(ends > F.col("post"), F.lit(False)))


def siblings() -> Window:
    return Window.partitionBy("doc_id", "parent").orderBy("pre")


def preceding_sibling(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(siblings())


def following_sibling(c: str | Column, n: int = 1) -> Column:
    return F.lead(c, n).over(siblings())


def following_siblings(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes with an earlier sibling in `of`."""
    first = of.groupBy("doc_id", "parent").agg(F.min("pre").alias("__first"))
    return nodes.join(first, ["doc_id", "parent"]).filter("pre > __first").select(nodes.columns)


def count_preceding(of: Column) -> Column:
    """How many nodes that hold `of` begin before, ancestors included."""
    return F.count(F.when(of, 1)).over(Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))


def positions(nodes: DataFrame) -> DataFrame:
    """position() and last() among siblings of the same name."""
    w = Window.partitionBy("doc_id", "parent", "local")
    return nodes.withColumn("position", F.row_number().over(w.orderBy("pre"))).withColumn("last", F.count("*").over(w))


def string_value(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """doc_id, pre and the text below each node of `of`, in document order."""
    texts = nodes.filter("kind = 'text'").select("doc_id", "pre", "post", "text")
    below = descendants(texts, of).groupBy("doc_id", F.col("top_pre").alias("pre"))
    return below.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "").alias("value"))


def numbering(nodes: DataFrame, levels: list[str], formats: list) -> DataFrame:
    """Sections with `number`, their places at each level joined by dots, each level formatted; nodes are the sections only.

    levels: for each depth the column of the ancestor at that depth (the last is the node's own order)."""
    out, keys = nodes, ["doc_id"]
    parts = []
    for k, (level, fmt) in enumerate(zip(levels, formats)):
        out = out.withColumn(f"__n{k}", F.dense_rank().over(Window.partitionBy(*keys).orderBy(level)))
        keys.append(level)
        parts.append(fmt(F.col(f"__n{k}")))
    return out.withColumn("number", F.concat_ws(".", *parts)).drop(*(f"__n{k}" for k in range(len(levels))))


def serialise(nodes: DataFrame, opening: Column, closing: Column) -> DataFrame:
    """doc_id and xml: every node's opening at its beginning and closing at its end, text between; one group per document."""
    end = F.col("last") if "last" in nodes.columns else F.max("pre").over(Window.partitionBy("doc_id").orderBy("post").rowsBetween(Window.unboundedPreceding, 0))  # the last node within
    rows = nodes.withColumn("__end", F.greatest(end, "pre"))
    # tokens: an opening or a text at (pre, 0), a closing at (last node within, 1, deepest first)
    first = F.struct(F.col("pre").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.when(F.col("kind") == "elem", opening).otherwise(F.coalesce("text", F.lit(""))).alias("tok"))
    last = F.struct(F.col("__end").alias("a"), F.lit(1).alias("b"), (-F.col("depth")).alias("c"), F.when(F.col("kind") == "elem", closing).otherwise(F.lit("")).alias("tok"))
    tokens = rows.select("doc_id", F.explode(F.array(first, last)).alias("e"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["tok"]), "")
    return tokens.groupBy("doc_id").agg(joined.alias("xml"))
