"""Documents within documents, and the files that configure them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

INCLUDE = r'<xi:include\b[^>]*?/>|<xi:include\b[^>]*>[\s\S]*?</xi:include>'
PROLOGUE = r"^\s*(<\?xml[^>]*\?>)?\s*(<!DOCTYPE[^>\[]*(\[[^\]]*\])?\s*>)?\s*"


def expand(docs: DataFrame, name: str, content: str, most: int = 5) -> DataFrame:
    """name, content with the documents that it includes, and the names of those that aren't there (their fallbacks are taken), joined by blanks.

    Includes are joined by name, level by level, `most` at the deepest; what is included deeper, as by a circle, counts as missing. parse="text" gives the text itself. Text and pieces of a document stay in order by
    their places; a document that is included by very many is one row of the join for each of them, which AQE splits. Null contents include nothing."""
    files = docs.select(F.col(name).alias("__file"), F.col(content).alias("__raw")).dropDuplicates(["__file"])
    rows = docs.select(F.col(name).alias("name"), F.coalesce(F.col(content), F.lit("")).alias("content"), F.array().cast("array<string>").alias("missing"))
    rows = rows.withColumn("content", F.regexp_replace("content", PROLOGUE, ""))
    for level in range(most + 1):
        tags = F.regexp_extract_all("content", F.lit(f"({INCLUDE})"), F.lit(1))
        # each piece of text with the include behind it; the last piece has none
        pieces = F.arrays_zip(F.split("content", INCLUDE, -1).alias("text"), tags.alias("tag"))
        cut = rows.select("name", "missing", F.posexplode(pieces).alias("pos", "p")).select("name", "missing", "pos", "p.text", "p.tag")
        href, as_text = F.regexp_extract("tag", r'^<xi:include\b[^>]*\bhref="([^"]*)"', 1), F.col("tag").rlike(r'^<xi:include\b[^>]*\bparse="text"')
        cut = cut.withColumn("__file", F.when(F.col("tag").isNotNull(), href)).join(files, "__file", "left")
        fallback = F.regexp_extract("tag", r"<xi:fallback\b[^>]*>([\s\S]*?)</xi:fallback>", 1)
        found = F.col("__raw").isNotNull() & F.lit(level < most)
        put = F.when(F.col("tag").isNull(), "").when(~found, fallback).when(as_text, T.xml_escape(F.col("__raw"))).otherwise(F.regexp_replace("__raw", PROLOGUE, ""))
        lost = F.when(F.col("tag").isNotNull() & ~found, F.col("__file"))
        piece = F.struct("pos", F.concat("text", F.coalesce(put, F.lit(""))).alias("s"), lost.alias("lost"))
        whole = cut.groupBy("name").agg(F.array_sort(F.collect_list(piece)).alias("ps"), F.first("missing").alias("missing"))
        rows = whole.select("name", F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("content"), F.concat("missing", F.filter(F.transform("ps", lambda p: p["lost"]), lambda x: x.isNotNull())).alias("missing"))
    return rows.select(F.col("name").alias(name), F.col("content").alias(content), F.array_join("missing", " ").alias("missing"))


def configured(docs: DataFrame, path: str, given: str, files: DataFrame) -> DataFrame:
    """docs with `config`: what is given, else the first there of the files (file, config) that may stand beside a document: its name with .json, without a final _article; its whole name and .json; related.json of its folder."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    asked = [F.regexp_replace(path, "(_article)?[.]xml$", ".json"), F.concat(path, F.lit(".json")), F.concat(folder, F.lit("related.json"))]
    out = docs
    for k, file in enumerate(asked):
        out = out.withColumn("__file", file).join(files.select(F.col("file").alias("__file"), F.col("config").alias(f"__config{k}")), "__file", "left").drop("__file")
    names = [f"__config{k}" for k in range(len(asked))]
    return out.withColumn("config", F.coalesce(given, *names)).drop(*names)
