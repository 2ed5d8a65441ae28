"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import assembled, constructs, damage, extras, lookups, markup, office, references, revisions, scans, sequences, texts, trees  # noqa: F401
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["reconcile_title_h1"](spark, sf_dir)


__all__ = ["QUERIES", "SQL", "flagship"]
