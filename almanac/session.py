"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "almanac", **more: str) -> SparkSession:
    """UTC, adaptive execution with skew-join splitting, Arrow transfer; `more` overrides (dots as underscores)."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in more.items()}
    builder = SparkSession.builder.appName(name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
