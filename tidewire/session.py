"""A session with the settings the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewire", **conf: str) -> SparkSession:
    """UTC periods, adaptive execution, Arrow for the few Python columns; ``conf`` comes last."""
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=base | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
