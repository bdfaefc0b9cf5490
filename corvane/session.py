"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corvane") -> SparkSession:
    """The active session, or a new one. Column names of sources keep their case; adaptive execution splits skewed joins."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.caseSensitive", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
