"""Checks on catalogues and deliveries: coverage of requests, collisions, declared against present, usable documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the head of a page that is no document holds, and the least size of one.
REJECTED = ("The requested URL was rejected", "<title>Request Rejected</title>", "Access Denied", 'window["bobcmn"]', "awsWafCookieDomainList", "gokuProps")
LISTINGS, LEAST_BYTES = ("<title>Index of /", "<h1>Index of /"), 2_000


def missing_combinations(spark, axes: Mapping[str, Sequence[object]], present: DataFrame) -> DataFrame:
    """Combinations of the axes that `present` doesn't have. The axes are short lists of a request, and only they are multiplied."""
    grid = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        grid = one if grid is None else grid.crossJoin(one)  # a request's own short lists
    return grid.join(present.select(*axes).distinct(), list(axes), "left_anti")


def collisions(df: DataFrame, target: str, owner: str) -> DataFrame:
    """Targets that more than one owner writes to, and the owners in order."""
    return df.groupBy(target).agg(F.array_sort(F.collect_set(owner)).alias("owners")).where(F.size("owners") > 1)


def declared_against_present(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """One row per key of either side: ok, missing or undeclared."""
    a, b = declared.select(key).distinct().withColumn("__d", F.lit(True)), present.select(key).distinct().withColumn("__p", F.lit(True))
    state = F.when(F.col("__p").isNull(), "missing").when(F.col("__d").isNull(), "undeclared").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def verdict(checks: DataFrame, by: Sequence[str], state: str, strict: bool = False) -> DataFrame:
    """ready, ready with gaps, or not ready, from the states of the checks."""
    bad, gap = F.count_if(F.col(state) == "missing"), F.count_if(F.col(state) == "undeclared")
    return checks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_checks"), F.when(bad > 0, "not ready").when((gap > 0) & F.lit(strict), "not ready").when(gap > 0, "ready with gaps").otherwise("ready").alias("verdict"))


def why_not_a_document(head: Column, size: Column, least: int = LEAST_BYTES) -> Column:
    """The reason that a download is no document, or NULL."""
    out = F.when(size < least, F.format_string("only %d bytes", size))
    for marker in LISTINGS:
        out = F.when(F.contains(head, F.lit(marker)), "a directory listing").otherwise(out)
    for marker in REJECTED:
        out = F.when(F.contains(head, F.lit(marker)), "refused by the server").otherwise(out)
    return out


def news_signal(counts: Sequence[Column], cap: int = 250) -> tuple[Column, Column]:
    """Articles from several services: the largest count, as they overlap, NULL if none answered; and whether a cap was met."""
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return most, F.coalesce(most >= cap, F.lit(False))
