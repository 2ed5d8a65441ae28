"""A session with the settings that the plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "vellumix", **settings: str) -> SparkSession:
    """UTC and AQE; the master and all else come from the environment or `settings` (dots as double underscores)."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
