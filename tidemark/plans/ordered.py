"""Running sums, numbers, ranks, quantiles and carried values over ordered groups of any size.

A plain window puts a whole group into one task. Here a group above `rows_per_bucket` rows is first cut, by the
quantiles of its own order column, into consecutive buckets; windows run within a bucket, and a second, tiny
window over one row per bucket carries the totals across. Groups below the limit are one bucket, so the result
is the same whether a group is cut or not.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import join_same, measured_side, stage_counted

#: Rows of one group that one task may sort.
ROWS_PER_BUCKET = 1_000_000
#: Buckets that a group is cut into at most; beyond it buckets grow, and the sort of a bucket spills.
MAX_BUCKETS = 512
BUCKET = "__bucket"


def bucketed(df: DataFrame, group: Sequence[str], order: str, sizes: DataFrame | int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, bool]:
    """`df` with a bucket number per row, rising with `order` within `group`; and whether any group was cut.

    `sizes` may hold the columns of `group`, or some of them, and a column `rows` that is an upper bound of the
    group's rows; a cheap count of the raw table does. It may also be a number that no group's rows exceed. Rows with equal `order` always share a bucket.
    """
    if isinstance(sizes, int):
        if sizes <= rows_per_bucket:
            return df.withColumn(BUCKET, F.lit(0)), False
        sizes = None
    if sizes is None:
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
    keys = [c for c in sizes.columns if c in group]
    hot = sizes.filter(F.col("rows") > rows_per_bucket)
    largest = hot.agg(F.max("rows").alias("m")).first()["m"]
    if largest is None:
        return df.withColumn(BUCKET, F.lit(0)), False
    n = min(MAX_BUCKETS, math.ceil(largest / rows_per_bucket))
    marks = [i / n for i in range(1, n)]
    inside = join_same(df, measured_side(hot.select(*keys), "hot"), keys, "left_semi") if keys else df
    cuts = inside.groupBy(*group).agg(F.array_distinct(F.percentile_approx(F.col(order).cast("double"), marks, 20 * n)).alias("__cuts"))
    with_cuts = join_same(df, measured_side(cuts, "cuts"), group, "left") if group else df.crossJoin(F.broadcast(cuts))  # one row
    below = F.size(F.filter("__cuts", lambda c: c < F.col(order).cast("double")))
    return with_cuts.withColumn(BUCKET, F.when(F.col("__cuts").isNull(), 0).otherwise(below)).drop("__cuts"), True


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str = "below", sizes: DataFrame | int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`df` with `out`, the sum of `value` over the rows of the group that come before this one by `order`.

    `order` must tell the rows of a group apart, as it does in a table of value counts; its first column must be
    numeric. Input without rows gives none.
    """
    parts, cut = bucketed(df, group, order[0], sizes, rows_per_bucket)
    within = Window.partitionBy(*group, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    if cut:
        across = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        totals = parts.groupBy(*group, BUCKET).agg(F.sum(value).alias("__bucket_total"))
        offsets = totals.withColumn("__bucket_offset", F.coalesce(F.sum("__bucket_total").over(across), F.lit(0))).filter("__bucket_offset <> 0").drop("__bucket_total")
        parts = join_same(parts, measured_side(offsets, "offsets"), [*group, BUCKET], "left").withColumn(out, F.col(out) + F.coalesce("__bucket_offset", F.lit(0))).drop("__bucket_offset")
    return parts.drop(BUCKET)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "number", sizes: DataFrame | int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`df` with `out`, the place of each row in its group from 1; `order` as for running_sum."""
    counted = running_sum(df.withColumn("__one", F.lit(1)), group, order, "__one", out, sizes, rows_per_bucket)
    return counted.drop("__one").withColumn(out, F.col(out) + 1)


def count_up_to(df: DataFrame, group: Sequence[str], value: str, out: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`df` with `out`, the number of rows of the group whose `value` is at most this row's; NULL for a NULL value.

    Rows are counted by value first, so that equal values are one row of the running sum, and the counts come back
    by an equi-join on group and value.
    """
    counts, most = stage_counted(df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n")), "value_counts")
    summed = running_sum(counts, group, ["__v"], "__n", "__below", most, rows_per_bucket)
    upto = summed.select(*group, "__v", (F.col("__below") + F.col("__n")).alias(out))
    return join_same(df.withColumn("__v", F.col(value)), upto, [*group, "__v"], "left").drop("__v")


def quantiles_of_counts(counts: DataFrame, group: Sequence[str], value: str, n: str, totals: DataFrame, probs: Sequence[float], rows_per_bucket: int = ROWS_PER_BUCKET, most: int | None = None) -> DataFrame:
    """(`group`, quantiles ARRAY<DOUBLE>) of a table of value counts, by linear interpolation between the neighbouring ranks.

    `totals` has one row per group with `total`, the sum of its counts, and `rows`, its number of values; `most` may be a number that no group's `rows` exceed. Ranks come
    from running sums over the counts, so no group is gathered; at most two values a probability are kept.
    """
    totals = measured_side(totals, "totals")
    ranked = running_sum(counts, group, [value], n, "__below", totals if most is None or most > rows_per_bucket else most, rows_per_bucket)
    placed = join_same(ranked, totals.select(*group, F.col("total").alias("__total")), group) if group else ranked.crossJoin(F.broadcast(totals.select(F.col("total").alias("__total"))))  # one row
    end, picks, mixed, wanted = F.col("__below") + F.col(n), [], [], F.lit(False)
    at = lambda rank: F.max(F.when((F.col("__below") <= rank) & (rank < end), F.col(value)))
    for i, p in enumerate(probs):
        place = F.lit(p) * (F.col("__total") - 1)
        wanted = wanted | ((F.col("__below") <= F.ceil(place)) & (F.floor(place) < end))
        picks += [at(F.floor(place)).alias(f"__lo_{i}"), at(F.ceil(place)).alias(f"__hi_{i}")]
        mixed.append(F.col(f"__lo_{i}") + (F.col(f"__hi_{i}") - F.col(f"__lo_{i}")) * (place - F.floor(place)))
    few = placed.where(wanted)  # the values next to a wanted rank; all others needn't be aggregated
    return few.groupBy(*group).agg(F.max("__total").alias("__total"), *picks).select(*group, F.array(*mixed).alias("quantiles"))


def quantiles(df: DataFrame, group: Sequence[str], values: Mapping[str, Column], probs: Sequence[float], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per group that has a value, with an ARRAY<DOUBLE> of exact quantiles for each named value; NULL where that has none.

    Where no group has more than `rows_per_bucket` / 10 rows, which a count finds out, the built-in aggregate may hold
    one group's values in a task. Otherwise the values are unpivoted and counted once, whatever their number, and ranked by
    running sums. The result is the same.
    """
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0]
    if (largest or 0) <= rows_per_bucket // 10:
        out = df.groupBy(*group).agg(*(F.percentile(v.cast("double"), list(probs)).alias(k) for k, v in values.items()))
        return out.where(reduce(lambda a, b: a | b, (F.col(k).isNotNull() for k in values)))
    long = df.select(*group, F.inline(F.array(*(F.struct(F.lit(k).alias("__f"), v.cast("double").alias("__v")) for k, v in values.items())))).where("__v IS NOT NULL")
    counts, most = stage_counted(long.groupBy(*group, "__f", "__v").agg(F.count(F.lit(1)).alias("__n")), "value_counts")
    totals = counts.groupBy(*group, "__f").agg(F.sum("__n").alias("total"), F.count(F.lit(1)).alias("rows"))
    found = quantiles_of_counts(counts, [*group, "__f"], "__v", "__n", totals, probs, rows_per_bucket, most)
    return found.groupBy(*group).agg(*(F.first(F.when(F.col("__f") == k, F.col("quantiles")), ignorenulls=True).alias(k) for k in values))


def carried(df: DataFrame, group: Sequence[str], order: str, fields: Sequence[str], sizes: DataFrame | int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`df` with `prev_f` and `next_f` for each field f: structs (at, value) of the nearest rows of the group before and after that have a value, or NULL.

    `df` has at most one row per group and value of `order`.
    """
    parts, cut = bucketed(df, group, order, sizes, rows_per_bucket)
    here = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("at"), F.col(f).alias("value")))
    back = Window.partitionBy(*group, BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group, BUCKET).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)  # a frame that ends at the last row is worked out anew for each
    parts = parts.withColumns({f"prev_{f}": F.last(here(f), ignorenulls=True).over(back) for f in fields} | {f"next_{f}": F.last(here(f), ignorenulls=True).over(ahead) for f in fields})
    if cut:
        ends = parts.groupBy(*group, BUCKET).agg(*(F.max(here(f)).alias(f"__l_{f}") for f in fields), *(F.min(here(f)).alias(f"__f_{f}") for f in fields))
        before = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*group).orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*group, BUCKET, *(F.last(f"__l_{f}", ignorenulls=True).over(before).alias(f"__p_{f}") for f in fields), *(F.last(f"__f_{f}", ignorenulls=True).over(after).alias(f"__n_{f}") for f in fields))
        parts = join_same(parts, measured_side(ends, "ends"), [*group, BUCKET], "left")
        parts = parts.withColumns({f"prev_{f}": F.coalesce(f"prev_{f}", f"__p_{f}") for f in fields} | {f"next_{f}": F.coalesce(f"next_{f}", f"__n_{f}") for f in fields})
        parts = parts.drop(*(f"__p_{f}" for f in fields), *(f"__n_{f}" for f in fields))
    return parts.drop(BUCKET)
