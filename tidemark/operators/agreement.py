"""Modelled against observed: confusion counts, hit rate, false alarms, overlap; area-weighted and conditional shares; facility counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import safe_ratio

#: Fixed values of the observed raster: permanent water, and what counts as observed water in centimetres for a depth in metres.
PERMANENT_WATER_CM = 9_999
CM_PER_M = 100
#: Fixed value: countries that some sources write in another way.
RENAMED_COUNTRIES = {"GR": "EL"}


def modelled_wet(depth_m: Column, least_m: float, nodata: float = -9_999.0) -> Column:
    """Deeper than the threshold; no data is dry."""
    return F.coalesce((depth_m != nodata) & ~F.isnan(depth_m) & (depth_m > least_m), F.lit(False))


def observed_wet(depth_cm: Column, least_m: float) -> Column:
    return F.coalesce((depth_cm != PERMANENT_WATER_CM) & (depth_cm > least_m * CM_PER_M), F.lit(False))


def modelled_domain(depth_m: Column, nodata: float = -9_999.0) -> Column:
    """Cells that the model covers at all."""
    return F.coalesce((depth_m != nodata) & ~F.isnan(depth_m), F.lit(False))


def is_runoff(code: Column) -> Column:
    """Cells whose class, the hundreds of the code, is one of runoff and not of a river."""
    return F.coalesce(F.floor(code / 100).isin(2, 3), F.lit(False))


def confusion(df: DataFrame, keys: Sequence[str], modelled: Column, observed: Column, scorable: Column | None = None, least_observed: int = 25, runoff: Column | None = None, domain: Column | None = None) -> DataFrame:
    """Per key: hits, misses, false alarms, and their ratios, NULL where the denominator is 0 or there are fewer than `least_observed` observed cells.

    With `runoff`, the misses inside and outside of it and the hit rate outside, for which both sides of the ratio are
    taken outside; with `domain`, the cells that the model doesn't cover. Both count scorable cells. One pass counts all.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    m, o, s = yes(modelled), yes(observed), yes(scorable) if scorable is not None else F.lit(True)
    counts = {"n_cells": F.count(F.lit(1)), "hits": F.count_if(s & m & o), "misses": F.count_if(s & ~m & o), "false_alarms": F.count_if(s & m & ~o)}
    if runoff is not None:
        r = yes(runoff)
        counts |= {"misses_in_runoff": F.count_if(s & ~m & o & r), "misses_outside_runoff": F.count_if(s & ~m & o & ~r), "__hits_outside": F.count_if(s & m & o & ~r)}
    if domain is not None:
        counts["outside_domain"] = F.count_if(s & ~yes(domain))
    c = df.groupBy(*keys).agg(*(v.alias(k) for k, v in counts.items()))
    seen = F.col("hits") + F.col("misses")
    shown = lambda x: F.when(seen >= least_observed, x)
    ratios = {"hit_rate": safe_ratio(F.col("hits"), seen), "false_alarm_ratio": safe_ratio(F.col("false_alarms"), F.col("hits") + F.col("false_alarms")), "overlap": safe_ratio(F.col("hits"), seen + F.col("false_alarms"))}
    if runoff is not None:
        ratios["hit_rate_outside_runoff"] = safe_ratio(F.col("__hits_outside"), F.col("__hits_outside") + F.col("misses_outside_runoff"))
    return c.select(*keys, *(k for k in counts if not k.startswith("__")), *(shown(v).alias(k) for k, v in ratios.items()))


def shares_where_reported(regions: DataFrame, measured_areas: DataFrame, reporters: DataFrame, key: str, country: str, area: str, flooded: str, renamed: Mapping[str, str] = RENAMED_COUNTRIES) -> DataFrame:
    """(key, area, flooded, share): the share of an area that is flooded, NULL where the country reports no area at all or there is none to divide by.

    `reporters` holds the countries of the network's sites, some in another spelling (`renamed`); a region without any
    area in a reporting country has 0, which is measured.
    """
    names = F.create_map(*(F.lit(x) for pair in renamed.items() for x in pair))
    there = reporters.where(F.col(country).isNotNull()).select(F.coalesce(F.element_at(names, F.col(country)), F.col(country)).alias(country)).distinct().withColumn("__in", F.lit(True))
    joined = regions.select(key, country).join(measured_areas.select(key, area, flooded), key, "left").join(there, country, "left")
    told = lambda c: F.when(F.col("__in"), F.coalesce(F.col(c), F.lit(0.0)))
    return joined.select(key, told(area).alias(area), told(flooded).alias(flooded), safe_ratio(told(flooded), told(area)).alias("share"))


def both_measured_share(df: DataFrame, keys: Sequence[str], part: str, whole: str) -> DataFrame:
    """Sums of two areas over the rows where both are measured, and their ratio."""
    both = F.col(part).isNotNull() & F.col(whole).isNotNull()
    sums = df.groupBy(*keys).agg(F.sum(F.when(both, F.col(part))).alias(part), F.sum(F.when(both, F.col(whole))).alias(whole), F.count_if(both).alias("n_both"))
    return sums.withColumn("share", safe_ratio(F.col(part), F.col(whole)))


def headline(scores: DataFrame) -> DataFrame:
    """`scores` with a sentence that says when a rate is not defined."""
    rate = F.when(F.col("hit_rate").isNull(), F.lit("hit rate not defined")).otherwise(F.format_string("hit rate %.1f %%", F.col("hit_rate") * 100))
    return scores.withColumn("headline", F.concat(rate, F.format_string(" of %d observed cells", F.col("hits") + F.col("misses"))))


def weighted_shares(df: DataFrame, keys: Sequence[str], weight: Column, flags: dict[str, Column], valid: Column | None = None) -> DataFrame:
    """Per key: total weight of the valid cells, weight and share of each flag, share of valid cells."""
    v = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    w = F.when(v, weight)
    s = df.groupBy(*keys).agg(F.sum(w).alias("area"), *(F.sum(F.when(F.coalesce(f, F.lit(False)), w).otherwise(0.0)).alias(f"{n}_area") for n, f in flags.items()), F.avg(v.cast("double")).alias("coverage"))
    return s.select(*keys, "area", *(c for n in flags for c in (F.col(f"{n}_area"), safe_ratio(F.col(f"{n}_area"), F.col("area")).alias(f"{n}_share"))), "coverage")


def weighted_mean_change(df: DataFrame, keys: Sequence[str], cell: str, time: str, value: Column, weight: Column, first: object, last: object) -> DataFrame:
    """Weighted mean at two times over the cells measured at both, and the change in percentage points.

    A first aggregation by cell makes a cell's two values one row, so a cell counts at both times or at neither.
    """
    one = df.groupBy(*keys, cell).agg(F.max(F.when(F.col(time) == first, value)).alias("__a"), F.max(F.when(F.col(time) == last, value)).alias("__b"), F.max(weight).alias("__w"))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    s = one.groupBy(*keys).agg(F.sum(F.when(both, F.col("__a") * F.col("__w"))).alias("__sa"), F.sum(F.when(both, F.col("__b") * F.col("__w"))).alias("__sb"), F.sum(F.when(both, F.col("__w"))).alias("__sw"), F.avg(both.cast("double")).alias("coverage"))
    a, b = safe_ratio(F.col("__sa"), F.col("__sw")), safe_ratio(F.col("__sb"), F.col("__sw"))
    return s.select(*keys, a.alias("share_first"), b.alias("share_last"), ((b - a) * 100).alias("change_pp"), "coverage")


def conditional_means(df: DataFrame, keys: Sequence[str], value: Column, inside: Column) -> DataFrame:
    """Mean over all valid cells, mean inside a footprint, and the counts behind both."""
    i = F.coalesce(inside, F.lit(False))
    return df.groupBy(*keys).agg(F.count(value).alias("n_valid"), F.avg(value).alias("mean_all"), F.count(F.when(i, value)).alias("n_inside"), F.avg(F.when(i, value)).alias("mean_inside"))


def facility_counts(points: DataFrame, regions: DataFrame, key: str, country: str, flags: dict[str, Column], weight: str | None = None) -> DataFrame:
    """Per region: facilities, those with each flag, and sums of a weight. 0 in a country that is covered, NULL in one without any facility; NULL weight sums where no facility reports one."""
    own = points.groupBy(key).agg(F.count(F.lit(1)).alias("n_total"), *(F.count_if(F.coalesce(f, F.lit(False))).alias(f"n_{n}") for n, f in flags.items()), *((F.sum(weight).alias("weight_total"),) if weight else ()))
    joined = regions.select(key, country).join(own, key, "left")
    covered = F.max(F.coalesce("n_total", F.lit(0))).over(Window.partitionBy(country)) > 0
    names = ["n_total", *(f"n_{n}" for n in flags)]
    return joined.select(key, country, *(F.when(covered, F.coalesce(n, F.lit(0))).alias(n) for n in names), *(("weight_total",) if weight else ()))
