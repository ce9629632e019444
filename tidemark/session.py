"""One place that builds a session with the settings every operator relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic, UTC and adaptive execution are what the operators are written for; sizes stay the cluster's own.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.pythonUDF.arrow.enabled": "true",
}


def session(app: str = "tidemark", master: str | None = None, shared: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; `shared` is the folder for staged tables, which all executors must reach, and is needed
    on a cluster whose own settings don't name one (spark.checkpoint.dir). `extra` overrides, with dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
