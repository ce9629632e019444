"""Nested administrative levels: totals at one level, coverage of a level by its children, values inherited from parents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import safe_ratio


class EmptySelection(ValueError):
    """Nothing was selected; a sum over nothing would read as "measured, none"."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """`df`, or EmptySelection if it has no rows. One task reads one row."""
    if df.isEmpty():
        raise EmptySelection(what)
    return df


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df`, or ValueError if a key occurs twice; for the one side of a many-to-one join."""
    twice = df.groupBy(*keys).count().where("count > 1")
    if (first := twice.first()) is not None:
        raise ValueError(f"not unique on {list(keys)}: {first}")
    return df


def select_level(df: DataFrame, level: str, value: str, level_column: str = "admin_unit_level", where: Column | None = None) -> DataFrame:
    """Rows of exactly one level: levels repeat each other, so no sum may span two."""
    return df.where((F.col(level_column) == level) & (where if where is not None else F.lit(True)))


def totals_by_unit(df: DataFrame, unit: str, value: str, firsts: Sequence[str] = (), events: str | None = None, sets: Sequence[str] = (), lists: Sequence[str] = (), separator: str = ",") -> DataFrame:
    """One row per unit: sum of `value` (NULL if none was measured), number of rows and of distinct `events`, the least of
    `firsts` (columns that are constant in a unit), sorted distinct `sets` and the union of the delimited `lists`, joined with the separator.

    Distinct values are gathered per unit as sets of labels, not as rows; partial aggregation makes them small before the shuffle.
    """
    tidy = lambda c: F.filter(F.transform(F.split(F.col(c), separator), F.trim), lambda x: x != "")
    out = [F.sum(value).alias(value), F.count(F.lit(1)).alias("n_rows")]
    out += [F.min(c).alias(c) for c in firsts]
    if events:
        out.append(F.count_distinct(events).alias("n_events"))
    out += [F.array_join(F.array_sort(F.collect_set(c)), separator).alias(c) for c in sets]
    work = df.withColumns({f"__items_{c}": F.explode_outer(tidy(c)) for c in lists}) if len(lists) == 1 else df
    if len(lists) == 1:
        # exploding repeats rows, so the lists get an aggregation of their own
        items = work.groupBy(unit).agg(F.array_join(F.array_sort(F.collect_set(f"__items_{lists[0]}")), separator).alias(lists[0]))
        return df.groupBy(unit).agg(*out).join(items, unit, "left")
    out += [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(tidy(c))))), separator).alias(c) for c in lists]
    return df.groupBy(unit).agg(*out)


def level_coverage(parents: DataFrame, children: DataFrame, parent: str, parent_of: str, value: str) -> DataFrame:
    """How much of each parent's total its children carry: full outer, so that orphans on either side stay visible.

    A parent without children has child_total 0 and n_children 0; a parent code that occurs only among children has
    a NULL parent_total and a NULL ratio. `parents` and `children` are totals by unit, so both sides are small
    against their facts and are reduced before the join.
    """
    rolled = children.groupBy(F.col(parent_of).alias(parent)).agg(F.sum(value).alias("child_total"), F.count(F.lit(1)).alias("n_children"))
    joined = parents.select(parent, F.col(value).alias("parent_total")).join(rolled, parent, "full_outer")
    child = F.coalesce("child_total", F.lit(0.0))
    return joined.select(parent, "parent_total", child.alias("child_total"), F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.col("parent_total") - child).alias("unattributed"), safe_ratio(child, F.col("parent_total")).alias("coverage_ratio"))


def ratio_to_total(units: DataFrame, total: DataFrame, value: str) -> DataFrame:
    """`units` with `ratio`, their value over the one total of the level above; NULL where that is absent or zero. `total` is one row with the column total."""
    return units.crossJoin(F.broadcast(total.select(F.col("total").alias("__total")))).withColumn("ratio", safe_ratio(F.col(value), F.col("__total"))).drop("__total")


def parent_value(units: DataFrame, parents: DataFrame, unit: str, parent_key: Column, code: str, value: str, out: str) -> DataFrame:
    """`units` with the value of the parent that `parent_key` (a prefix, say) names; NULL where there is none."""
    named = parents.select(F.col(code).alias("__code"), F.col(value).alias(out))
    return units.join(named, parent_key == F.col("__code"), "left").drop("__code")


def own_else_parent(units: DataFrame, parent_rows: DataFrame, parent_key: str, fields: Sequence[str], own: str = "own", inherited: str = "parent") -> DataFrame:
    """The unit's own row if any of `fields` is measured there, else the whole row of its parent; `level` says which.

    It is decided by row and not by column, so that values of two levels are never mixed in one row.
    """
    renamed = parent_rows.select(F.col(parent_key), *(F.col(f).alias(f"__p_{f}") for f in fields))
    joined = units.join(renamed, parent_key, "left")
    has_own = F.coalesce(*(F.when(F.col(f).isNotNull(), True) for f in fields), F.lit(False))
    has_parent = F.coalesce(*(F.when(F.col(f"__p_{f}").isNotNull(), True) for f in fields), F.lit(False))
    kept = [c for c in units.columns if c not in fields]
    return joined.select(*kept, *(F.when(has_own, F.col(f)).otherwise(F.col(f"__p_{f}")).alias(f) for f in fields), F.when(has_own, own).when(has_parent, inherited).alias("level"))


def latest_full_period(df: DataFrame, period: str, unit: str, floor: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """The newest period that covers at least `floor` as many distinct units as the period before it; the first period always does.

    Counts by period come first; the window then runs over one row per period.
    """
    counts = df.where(F.col(period).isNotNull()).groupBy(*by, period).agg(F.count_distinct(unit).alias("n_units")).where("n_units > 0")
    line = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(period)
    full = F.lag("n_units").over(line).isNull() | (F.col("n_units") >= F.lit(floor) * F.lag("n_units").over(line))
    marked = counts.withColumn("__full", full).where("__full")
    return marked.groupBy(*by).agg(F.max(period).alias(period), F.max_by("n_units", period).alias("n_units"))


def bucket_share(df: DataFrame, unit: str, bucket: str, value: str, total: str, buckets: Sequence[str]) -> DataFrame:
    """Sum over disjoint buckets / the total bucket; NULL unless every bucket is present, and for a total that isn't positive."""
    inside = F.col(bucket).isin(list(buckets))
    sums = df.groupBy(unit).agg(F.sum(F.when(inside, F.col(value))).alias("part"), F.count_distinct(F.when(inside & F.col(value).isNotNull(), F.col(bucket))).alias("n_buckets"), F.sum(F.when(F.col(bucket) == total, F.col(value))).alias("whole"))
    part = F.when(F.col("n_buckets") == len(buckets), F.col("part"))
    return sums.select(unit, "n_buckets", part.alias("part"), "whole", safe_ratio(part, F.when(F.col("whole") > 0, F.col("whole"))).alias("share"))


def label(code: Column, names: Mapping[str, str]) -> Column:
    """The name of a code, or the code itself."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(table, code) if names else F.lit(None), code)
