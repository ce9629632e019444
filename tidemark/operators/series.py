"""Time series per cell: yearly extremes, Sen's slope, the Mann-Kendall test, and trends by region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import measured, safe_ratio
from tidemark.plans.ordered import quantiles
from tidemark.plans.staging import join_same, stage


def expected_steps(year: Column, per_day: int = 4) -> Column:
    """Steps in a year, with leap years."""
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) * per_day


def yearly_extremes(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Largest and mean value per key and year, and the number of steps; partial aggregation reads each block once."""
    v = measured(F.col(value).cast("double"))
    return df.groupBy(*keys, F.year(time).alias("year")).agg(F.max(v).alias("annual_max"), F.avg(v).alias("annual_mean"), F.count(v).alias("n_steps"))


def _pairs(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """Per key the array of (slope, sign) over all pairs of years; one shuffle brings a key's years together, and the
    pairs are made inside the row, so they never travel. A key has one value per year."""
    v = measured(F.col(value).cast("double"))
    series = df.where(v.isNotNull() & F.col(year).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(year).alias("y"), v.alias("v")))).alias("__s"))
    later = lambda a, i: F.transform(F.slice("__s", i + 2, F.size("__s")), lambda b: F.struct(((b["v"] - a["v"]) / (b["y"] - a["y"])).alias("slope"), F.signum(b["v"] - a["v"]).alias("sign")))
    return series.select(*keys, F.size("__s").alias("n_years"), F.flatten(F.transform("__s", later)).alias("__pairs"))


def _median(numbers: Column) -> Column:
    ordered = F.array_sort(numbers)
    n = F.size(numbers)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)


def trends(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """Sen's slope (median of the slopes of all pairs, by real years) and the Mann-Kendall Z (no correction for ties, with continuity correction); NULL under two years."""
    p = _pairs(df, keys, year, value)
    s = F.aggregate(F.transform("__pairs", lambda x: x["sign"]), F.lit(0.0), lambda a, x: a + x)
    n = F.col("n_years").cast("double")
    spread = F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    z = F.when(F.col("__sum") > 0, safe_ratio(F.col("__sum") - 1, spread)).when(F.col("__sum") < 0, safe_ratio(F.col("__sum") + 1, spread)).otherwise(0.0)
    slope = _median(F.transform("__pairs", lambda x: x["slope"]))
    return p.select(*keys, "n_years", slope.alias("sen_slope"), s.alias("__sum")).select(*keys, "n_years", "sen_slope", F.col("__sum").alias("mk_s"), F.when(F.col("n_years") > 1, z).alias("mk_z"))


def regional_trends(cells: DataFrame, region: str, slope: str, z: str, mean: str, critical: float = 1.96) -> DataFrame:
    """Median change in per cent per decade, share of cells that rise significantly, and cells, by region."""
    pct = safe_ratio(F.col(slope) * 1000, F.col(mean))
    cells = stage(cells.select(region, z, pct.alias("__pct")), "trends")
    sums = cells.groupBy(region).agg(F.avg(F.when(F.col(z).isNotNull(), (F.col(z) > critical).cast("double"))).alias("share_increasing"), F.count(F.lit(1)).alias("n_cells"))
    medians = quantiles(cells, [region], {"__q": F.col("__pct")}, [0.5])
    return join_same(sums, medians, [region], "left").select(region, F.get("__q", F.lit(0)).alias("pct_per_decade"), "share_increasing", "n_cells")


def complete_series(df: DataFrame, keys: Sequence[str], year: str, peak: str, mean: str, n_years: int, least_mean: float) -> DataFrame:
    """Keys with a peak in every year and a mean of at least `least_mean`."""
    s = df.groupBy(*keys).agg(F.count(measured(peak)).alias("n_years"), F.avg(measured(mean)).alias("mean_value"))
    return s.where((F.col("n_years") == n_years) & (F.col("mean_value") >= least_mean))


def highest_level(value: Column, thresholds: Column) -> Column:
    """The highest level whose threshold the value exceeds, of an array of (level, threshold) in ascending order; 0 for none, NULL if a threshold is missing or they don't rise strictly."""
    limits = F.transform(thresholds, lambda t: t["threshold"])
    n = F.size(limits)
    steps = F.zip_with(F.slice(limits, 1, n - 1), F.slice(limits, 2, n), lambda a, b: F.coalesce(a < b, F.lit(False)))
    rising = F.forall(steps, lambda x: x) & F.forall(limits, lambda x: x.isNotNull())
    passed = F.filter(thresholds, lambda t: value > t["threshold"])
    return F.when(value.isNotNull() & rising, F.coalesce(F.array_max(F.transform(passed, lambda t: t["level"])), F.lit(0)))
