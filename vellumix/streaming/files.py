"""Row-local operators on file streams: repair and extraction of documents as they arrive. They keep no state, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import repair


def read_documents(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def repaired(docs: DataFrame, name: str = "url", text: str = "html", rules: tuple[repair.Rule, ...] = repair.RULES) -> DataFrame:
    return repair.repair_documents(docs, name, text, rules)


def links(docs: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    found = F.regexp_extract_all(text, F.lit('href="([^"]*)"'), F.lit(1))
    return docs.select(key, F.explode(F.array_distinct(found)).alias("href"))


def write(docs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each file once, also after a restart: the file sink and its checkpoint."""
    return docs.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
