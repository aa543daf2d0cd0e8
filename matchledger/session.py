"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "matchledger", **conf: str) -> SparkSession:
    """The running session, or a new one: UTC, ANSI rules, adaptive plans. ``conf`` adds settings by name, with ``__``
    for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
