"""Layers joined onto regions: many-to-one joins that are checked, required keys, own and parent values, groups of units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import require_columns, require_unique


def onto(base: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    """`base` with the columns of `layer`, at most one row per key there; every row of `base` stays, once.

    ValueError if `layer` knows a key twice, or if a column other than the key is in both. Rows with a NULL key get
    NULLs. The check is one aggregation of the layer's keys; the join is left to Catalyst, which broadcasts a small layer.
    """
    require_columns(base, [key])
    require_columns(layer, [key])
    if clash := sorted((set(base.columns) & set(layer.columns)) - {key}):
        raise ValueError(f"columns in both: {clash}")
    return base.join(require_unique(layer.where(F.col(key).isNotNull()), [key]), key, "left")


def assemble(base: DataFrame, layers: Sequence[DataFrame], key: str) -> DataFrame:
    """`base`, itself with one row per key, with the columns of every layer side by side; a region that a layer lacks gets NULLs there."""
    return reduce(lambda done, layer: onto(done, layer, key), layers, require_unique(base, [key]))


def reindex(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """One row per required key, in whatever order, with the values of `df` or NULLs; keys that only `df` has are left out."""
    return onto(keys.select(key).distinct(), df, key)


def own_and_parent(keys: DataFrame, key: str, parent: Column, own: DataFrame, parents: DataFrame, code: str) -> DataFrame:
    """One row per key with the columns of `own`, and of `parents` (another indicator, published for the level above) found by `parent`, an expression of the key."""
    with_own = reindex(keys, own, key).withColumn("__parent", parent)
    renamed = require_unique(parents.where(F.col(code).isNotNull()), [code]).withColumnRenamed(code, "__parent")
    return with_own.join(renamed, "__parent", "left").drop("__parent")


def group_of(code: Column, groups: Mapping[str, str], prefix: str = "district:") -> Column:
    """The declared group of a unit, or a group of its own named by prefix and code: a unit nobody grouped must not fall in with others."""
    table = F.create_map(*(F.lit(x) for pair in groups.items() for x in pair)) if groups else None
    own = F.concat(F.lit(prefix), code.cast("string"))
    return own if table is None else F.coalesce(F.element_at(table, code), own)


def star(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The fact table with its dimension's columns; ValueError if the fact has a key that the dimension lacks, since its rows would fall out of every total by group."""
    orphans = fact.where(F.col(key).isNotNull()).join(dimension, key, "left_anti").select(key)
    if (first := orphans.first()) is not None:
        raise ValueError(f"{key} without a row in the dimension: {first[key]!r}")
    return onto(fact, dimension, key)


def shared_groups(pieces: DataFrame, region: str, group: str, country: str, area: str, floor: float, names: Mapping[str, str] | None = None) -> DataFrame:
    """Per region what its groups share: (region, groups, countries_max, shared_with, shared_names).

    `pieces` is (region, country, group, area), one row per piece of a region in a group. A country belongs to a group if
    its pieces there come to at least `floor`; a group of two countries or more is shared. `shared_with` are the countries
    of the region's shared groups but its own, in order; `shared_names` their groups' names (or ids) by area, the largest
    first, of equal ones by name. Regions without a shared group have empty lists. Sets are of countries and groups,
    counted before they are gathered, so no rows are.
    """
    areas = pieces.groupBy(group, country).agg(F.sum(area).alias("__a")).where(F.col("__a") >= floor)
    groups = areas.groupBy(group).agg(F.array_sort(F.collect_set(country)).alias("__countries")).withColumn("__n", F.size("__countries"))
    own = pieces.groupBy(region, group).agg(F.sum(area).alias("__a"), F.collect_set(country).alias("__own"))
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.col(group)), F.col(group)) if names else F.col(group)
    joined = own.join(groups, group, "left").withColumns({"__shared": F.coalesce(F.col("__n") > 1, F.lit(False)), "__label": label})
    shared = lambda c: F.when(F.col("__shared"), c)
    per = joined.groupBy(region).agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.max("__n"), F.lit(0)).alias("countries_max"),
        F.array_distinct(F.flatten(F.collect_set("__own"))).alias("__own"),
        F.flatten(F.collect_set(shared(F.col("__countries")))).alias("__others"),
        F.array_sort(F.collect_list(shared(F.struct(-F.col("__a"), F.col("__label").alias("name"))))).alias("__named"),
    )
    others = F.array_sort(F.array_except(F.array_distinct("__others"), "__own"))
    return per.select(region, "groups", "countries_max", others.alias("shared_with"), F.transform("__named", lambda x: x["name"]).alias("shared_names"))
