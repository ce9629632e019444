"""Exposure over return periods: summaries of one scenario, expected annual exposure, extrapolation over windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import measured, safe_ratio

#: Fixed value: an event of this annual probability happens every year.
CERTAIN = 1.0


def annual_probability(df: DataFrame, period: str = "return_period") -> DataFrame:
    return df.withColumn("annual_probability", F.try_divide(F.lit(1.0), F.col(period).cast("double")))


def stacked(frames: Mapping[int, DataFrame], period: str = "return_period") -> DataFrame:
    """The frames of single scenarios as one long table, with the scenario and its annual probability as columns; they must have the same columns."""
    parts = [annual_probability(df.withColumn(period, F.lit(value)), period) for value, df in sorted(frames.items())]
    if not parts:
        raise ValueError("no scenario to stack")
    return reduce(lambda a, b: a.unionByName(b), parts)


def expected_annual_exposure(df: DataFrame, keys: Sequence[str], exposure: str = "exposed_pop", probability: str = "annual_probability") -> DataFrame:
    """Trapezoid integral of exposure over annual probability per unit, with the frequent tail and what was done.

    status is missing_exposure if any scenario isn't measured, insufficient_return_periods for fewer than two, else
    integrated; the figures are NULL unless integrated. One shuffle by unit: the window and the aggregation share it.
    """
    value, p = measured(F.col(exposure).cast("double")), F.col(probability)
    line = Window.partitionBy(*keys).orderBy(p)
    steps = df.select(*keys, value.alias("__x"), p.alias("__p"), F.lag(value).over(line).alias("__lx"), F.lag(p).over(line).alias("__lp"))
    sums = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_return_periods"),
        F.count_if(F.col("__x").isNull()).alias("__gaps"),
        F.sum((F.col("__x") + F.col("__lx")) / 2 * (F.col("__p") - F.col("__lp"))).alias("__area"),
        F.min("__p").alias("__low"),
        F.max("__p").alias("__high"),
        F.max_by("__x", "__p").alias("__last"),
    )
    status = F.when(F.col("__gaps") > 0, "missing_exposure").when(F.col("n_return_periods") < 2, "insufficient_return_periods").otherwise("integrated")
    good = lambda c: F.when(F.col("status") == "integrated", c)
    tail = 0.5 * F.col("__last") * F.greatest(F.lit(CERTAIN) - F.col("__high"), F.lit(0.0))
    return sums.withColumn("status", status).select(*keys, "n_return_periods", good(F.col("__area")).alias("expected_annual_exposure"), good(tail).alias("frequent_tail_exposure"), good(F.col("__area") + tail).alias("expected_annual_exposure_closed"), good(F.col("__low")).alias("probability_band_low"), good(F.col("__high")).alias("probability_band_high"), "status")


def scenario_summary(df: DataFrame, scenario: Sequence[str], value: str = "exposed_pop") -> DataFrame:
    """Per scenario, never across: rows, rows not measured, and the sum of what was measured (0 if nothing was)."""
    v = measured(value)
    return df.groupBy(*scenario).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_unmeasured"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{value}_sum"))


def extrapolated(df: DataFrame, keys: Sequence[str], exposed: str, people: str, coverage: str) -> DataFrame:
    """Exposure of a unit from partly covered cells or windows: all sums first, one division at the end, so windows add up.

    sum(exposed) * sum(people) / sum(people * coverage); NULL where nothing is covered.
    """
    e, p, c = measured(exposed), measured(people), measured(coverage)
    sums = df.groupBy(*keys).agg(F.sum(e).alias("observed"), F.sum(p).alias("people"), F.sum(p * c).alias("covered_people"), F.avg(c).alias("mean_coverage"), F.count(F.lit(1)).alias("n_cells"))
    return sums.withColumn("extrapolated", F.col("observed") * safe_ratio(F.col("people"), F.col("covered_people")))


def wide_by_scenario(df: DataFrame, keys: Sequence[str], scenario: str, value: str, scenarios: Sequence[int], prefix: str) -> DataFrame:
    """One column per scenario of a given list, so no job has to look for the values."""
    cell = lambda s: F.max(F.when(F.col(scenario) == s, measured(value))).alias(f"{prefix}{s}")
    return df.groupBy(*keys).agg(*(cell(s) for s in scenarios))


def residual(df: DataFrame, keys: Sequence[str], scenario: str, exposed: str, standard: str) -> DataFrame:
    """Exposure left behind defences: rows whose protection standard holds the scenario (standard >= return period) count as dry; an unknown standard protects nothing."""
    held = F.coalesce(F.col(standard) >= F.col(scenario), F.lit(False))
    v = measured(exposed)
    return df.groupBy(*keys, scenario).agg(F.sum(v).alias(f"{exposed}_all"), F.sum(F.when(held & v.isNotNull(), 0.0).otherwise(v)).alias(f"{exposed}_residual"), F.count_if(held).alias("n_held"))


def scenario_class(period: str, named: int = 100) -> Column:
    """Whether a scenario is more frequent than, as frequent as, or rarer than the one that the law names."""
    c = F.col(period)
    return F.when(c < named, "frequent").when(c == named, "named").when(c > named, "rare")
