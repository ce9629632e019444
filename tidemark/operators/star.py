"""Measures over a star of regions (dimension) and exposure (fact): each is an aggregate of what is in the filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import measured, safe_ratio


def chosen_scenario(chosen: Sequence[object] | None, default: object) -> object | None:
    """The scenario of a filter: the one chosen, `default` where nothing is, None where several are, since they are nested and have no sum."""
    if chosen is None:
        return default
    return chosen[0] if len(set(chosen)) == 1 else None


def scenario_label(chosen: Sequence[object] | None, default: object) -> str:
    """The chosen scenario in words, for titles."""
    one = chosen_scenario(chosen, default)
    return "Pick one return period" if one is None else f"1-in-{one}-year river flood"


def selected_scenario(df: DataFrame, scenario: str, keys: Sequence[str], value: str, default: object, chosen: Sequence[object] | None = None) -> DataFrame:
    """Sum of `value` per key over one scenario, never over several.

    Without a choice: the only one there, else `default`; blank (NULL) if there are several and that isn't among them.
    With one chosen, that; with several chosen, blank everywhere.
    """
    if chosen is not None:
        one = chosen_scenario(chosen, default)
        n = df.where(F.col(scenario).isin(list(chosen))).groupBy(*keys).agg(F.count_distinct(scenario).alias("n_scenarios"), F.sum(F.when(F.col(scenario) == F.lit(one), measured(value))).alias(f"{value}_selected"))
        return n.withColumn(f"{value}_selected", F.lit(None).cast("double")) if one is None else n
    per = df.groupBy(*keys, scenario).agg(F.sum(measured(value)).alias("__v"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scenarios"), F.max("__v").alias("__any"), F.max(F.when(F.col(scenario) == F.lit(default), F.col("__v"))).alias("__chosen")).select(*keys, "n_scenarios", F.when(F.col("n_scenarios") == 1, F.col("__any")).otherwise(F.col("__chosen")).alias(f"{value}_selected"))


def shared_measures(value: str, total_annual: str, shared: Column, declared: Column) -> list[Column]:
    """Over rows of one scenario: the value in shared basins, its share of all, the sum of the annual expectation, regions with a declared area, and in shared basins."""
    inside = F.sum(F.when(F.coalesce(shared, F.lit(False)), measured(value)))
    return [
        inside.alias(f"{value}_shared"),
        safe_ratio(inside, F.sum(measured(value))).alias("shared_share"),
        F.sum(measured(total_annual)).alias("expected_annual"),
        F.count_if(F.coalesce(declared, F.lit(False))).alias("regions_declared"),
        F.count(F.lit(1)).alias("regions"),
        F.count_if(F.coalesce(shared, F.lit(False))).alias("regions_shared"),
    ]


def share(top: Column, bottom: Column) -> Column:
    return safe_ratio(top, bottom)


def weighted_rate(rate: str, weight: str) -> Column:
    """Mean of a rate by weight; rows where either isn't measured are out of both sides."""
    r, w = measured(rate), measured(weight)
    both = r.isNotNull() & w.isNotNull()
    return safe_ratio(F.sum(F.when(both, r * w)), F.sum(F.when(both, w)))


def only_value(column: str) -> Column:
    """The value if it is the only one in the filter, else NULL."""
    return F.when(F.count_distinct(column) == 1, F.min(column))


def label_of(column: str, none: str = "none", several: str = "several") -> Column:
    n = F.count_distinct(column)
    return F.when(n == 0, none).when(n == 1, F.min(column)).otherwise(several)


def n_of_m(flag: Column, among: Column) -> Column:
    return F.format_string("%d of %d", F.count_if(F.coalesce(flag, F.lit(False))), F.count_if(among))


def drill(df: DataFrame, levels: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """The measures at every level of a hierarchy and in total, with `level`, the number of levels that are set."""
    depth = F.lit(len(levels)) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return df.rollup(*levels).agg(*measures, depth.alias("level"))
