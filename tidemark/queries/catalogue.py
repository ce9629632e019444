"""The modules whose queries the driver runs, without the optional llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.queries import layers, problems, relational, text_and_series

MODULES = (problems, relational, text_and_series, layers)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return relational.ask_spec_topn(spark, d)
