"""Medians and quantiles of relative change over cells and model members; never means or maxima of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import measured
from tidemark.operators.selection import period_label, warming_label
from tidemark.plans.ordered import quantiles
from tidemark.plans.staging import join_same


QUARTILES = (0.25, 0.5, 0.75)
#: Fixed value: the form of a region's code.
REGION_CODE = "[A-Z]{2}[0-9A-Z]{0,3}"


def finite(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def quartiles(df: DataFrame, keys: Sequence[str], value: str, least: int = 10) -> DataFrame:
    """Exact quartiles by linear interpolation and the count of finite values; NULL under `least` values.

    They come from running sums over value counts, so no group's values are held together.
    """
    v = finite(value)
    n = df.groupBy(*keys).agg(F.count(v).alias("n_points"))
    q = join_same(n, quantiles(df, keys, {"__q": v}, QUARTILES), keys, "left")
    enough = lambda i: F.when(F.col("n_points") >= least, F.get("__q", F.lit(i)))
    return q.select(*keys, "n_points", enough(0).alias("p25"), enough(1).alias("median"), enough(2).alias("p75"))


def ensemble(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Over the members of each key: median, range, quartiles, number of members, agreement on the sign (two members at least, all of one sign)."""
    v = finite(value)
    out = df.groupBy(*keys).agg(F.min(v).alias("ensemble_min"), F.max(v).alias("ensemble_max"), F.count(v).alias("ensemble_members"), F.count_if(v > 0).alias("__up"), F.count_if(v < 0).alias("__down"))
    out = join_same(out, quantiles(df, keys, {"__q": v}, QUARTILES), keys, "left")
    n = F.col("ensemble_members")
    agrees = (n >= 2) & ((F.col("__up") == n) | (F.col("__down") == n))
    return out.select(*keys, F.get("__q", F.lit(1)).alias("ensemble_median"), "ensemble_min", "ensemble_max", F.get("__q", F.lit(0)).alias("ensemble_p25"), F.get("__q", F.lit(2)).alias("ensemble_p75"), "ensemble_members", agrees.alias("ensemble_agrees_on_sign"))


def models_agree(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Three-valued: NULL if a member isn't measured, else whether all have one sign and it isn't zero."""
    v = finite(value)
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count(v).alias("__k"), F.min(F.signum(v)).alias("__low"), F.max(F.signum(v)).alias("__high"))
    return s.select(*keys, F.when(F.col("__n") == F.col("__k"), (F.col("__low") == F.col("__high")) & (F.col("__low") != 0)).alias("models_agree"))


def size_uncertain(low: Column, high: Column, limit: float = 100.0) -> Column:
    """The range of the members is wider than `limit`; False where it isn't measured."""
    return F.coalesce(high - low > limit, F.lit(False))


def medians_side_by_side(df: DataFrame, key: str, members: Mapping[str, Column], value: str) -> DataFrame:
    """One row per key with the median of the finite values of each named member, a condition on the rows; NULL for a member without any.

    All members are counted in one pass, each file of a member being rows that its condition tells.
    """
    found = quantiles(df, [key], {name: F.when(rows, finite(value)) for name, rows in members.items()}, [0.5])
    return df.select(key).distinct().join(found.select(key, *(F.get(n, F.lit(0)).alias(n) for n in members)), key, "left")


def tidy_long(df: DataFrame, value: str, pattern: str = REGION_CODE, warming: str | None = None, period: str | None = None) -> DataFrame:
    """A long indicator frame made uniform: the region column, found by its content, named region_code; labels of warming levels and periods in one form; rows without a finite value dropped.

    ValueError if no column holds region codes alone.
    """
    region = find_code_column(df, pattern)
    if region is None:
        raise ValueError(f"no column of region codes in {df.columns}")
    out = drop_unmeasured(df, value).withColumnRenamed(region, "region_code")
    labels = {c: f(F.col(c)) for c, f in ((warming, warming_label), (period, period_label)) if c}
    return out.withColumns(labels) if labels else out


def period_summary(df: DataFrame, periods: Sequence[str], stems: Mapping[str, str]) -> DataFrame:
    """Wide columns <stem>_<period> summed up by period: members, regions measured, median of medians, regions agreeing, regions with an uncertain size.

    `stems` names the columns members, median, low, high and agrees. One unpivot in the scan, one small aggregation.
    """
    rows = F.array(*(F.struct(F.lit(p).alias("period"), *(F.col(f"{s}_{p}").alias(k) for k, s in stems.items())) for p in periods))
    long = df.select(F.inline(rows))
    sums = long.groupBy("period").agg(F.max("members").alias("members"), F.count("median").alias("n_measured"), F.count_if("agrees").alias("n_agreeing"), F.count_if(size_uncertain(F.col("low"), F.col("high"))).alias("n_size_uncertain"))
    medians = quantiles(long, ["period"], {"__q": finite("median")}, [0.5])
    return join_same(sums, medians, ["period"], "left").select("period", "members", "n_measured", F.get("__q", F.lit(0)).alias("median_change"), "n_agreeing", "n_size_uncertain")


def find_code_column(df: DataFrame, pattern: str) -> str | None:
    """The first text column all of whose values have the form of a region code; one pass over the text columns."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return None
    row = df.agg(*(F.bool_and(F.col(c).rlike(f"^(?:{pattern})$")).alias(c) for c in names)).first()
    return next((c for c in names if row[c]), None)


def drop_unmeasured(df: DataFrame, value: str) -> DataFrame:
    return df.where(finite(value).isNotNull()).withColumn(value, measured(value))
