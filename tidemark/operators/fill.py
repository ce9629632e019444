"""Missing values filled from the same entity at other times, or from the entity's group at the same time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import distinct_rows
from tidemark.plans.ordered import ROWS_PER_BUCKET, carried
from tidemark.plans.staging import measured_side, stage, stage_counted


def _summary(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], prefix: str = "") -> DataFrame:
    """By keys, mean or most frequent value of each field (of equally frequent ones the smallest), and n_f, its number of values.

    All fields are counted by value in one pass, so a hot key, and a category with many values, are reduced before
    any key is brought together; a number needs only its sum and count there. Then one small grouping by the keys.
    """
    value = lambda f: F.struct(F.lit(f).alias("__f"), F.col(f).cast("string").alias("__v"), F.lit(None).cast("double").alias("__x"))
    number = lambda f: F.struct(F.lit(f).alias("__f"), F.lit(None).cast("string").alias("__v"), F.col(f).cast("double").alias("__x"))
    here = F.struct(F.lit(None).cast("string").alias("__f"), F.lit(None).cast("string").alias("__v"), F.lit(None).cast("double").alias("__x"))  # keeps keys without any value
    long = df.select(*keys, F.inline(F.array(here, *map(number, numeric), *map(value, categorical)))).where("__f IS NULL OR __v IS NOT NULL OR __x IS NOT NULL")
    counted = long.groupBy(*keys, "__f", "__v").agg(F.sum("__x").alias("__x"), F.count(F.lit(1)).alias("__n"))
    mine = lambda f, c: F.when(F.col("__f") == f, c)
    n = lambda f: F.coalesce(F.sum(mine(f, F.col("__n"))), F.lit(0)).alias(f"n_{f}")
    mean = lambda f: F.try_divide(F.sum(mine(f, F.col("__x"))), F.sum(mine(f, F.col("__n")))).alias(f"{prefix}{f}")
    # the largest count, then the smallest text
    mode = lambda f: F.min(mine(f, F.struct(-F.col("__n"), F.col("__v").alias("v"))))["v"].alias(f"{prefix}{f}")
    return counted.groupBy(*keys).agg(*map(mean, numeric), *map(mode, categorical), *map(n, [*numeric, *categorical]))


def fill_missing(
    df: DataFrame,
    record: str,
    entity: str,
    time: str,
    group: Column,
    numeric: Mapping[str, Column],
    categorical: Mapping[str, Column],
    max_gap: int = 4,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per record with, for each field f: f (given or filled), f_method, f_distance and f_donors.

    `numeric` and `categorical` map a field to the expression of its value, NULL where that is missing; so each
    data set's disguises of a missing value are its own affair. Methods, in order of preference:

    - ``observed``: the record has a value.
    - ``interpolated`` (numbers): the entity has values before and after, however far away; linear in time.
      f_distance is the distance to the nearer one.
    - ``carried`` (categories): the nearest value of the entity at most `max_gap` away; of two equally near ones
      the earlier.
    - ``group``: mean or most frequent value of the other records of the same group and time; f_distance 0.
    - ``carried`` (numbers): as for categories.
    - ``none``: nothing to fill from; the value stays NULL.

    f_donors is the number of records of the same group and time that have a value, whichever method was used.
    Several values of one entity at one time count as their mean, or most frequent one. Rows equal in all columns
    are one record. A NULL entity, group or time gives no series or donors of its own, and its records stay
    as they are. An empty table gives no rows; further columns are ignored but for telling repeats apart.
    """
    fields = [*numeric, *categorical]
    keep = list(df.columns)
    slim = distinct_rows(df, keep).select(F.col(record).alias("__record"), F.col(entity).alias("__entity"), F.col(time).alias("__time"), group.alias("__group"), *(c.alias(f) for f, c in (dict(numeric) | dict(categorical)).items()))
    rows = stage(slim, "fill_rows")
    placed = rows.filter("__entity IS NOT NULL AND __time IS NOT NULL")
    series, most = stage_counted(_summary(placed, ["__entity", "__time"], list(numeric), list(categorical)), "series")
    near = carried(series.select("__entity", "__time", *fields), ["__entity"], "__time", fields, most, rows_per_bucket)
    near = near.select("__entity", "__time", *(f"prev_{f}" for f in fields), *(f"next_{f}" for f in fields))
    donors = _summary(rows.filter("__group IS NOT NULL AND __time IS NOT NULL"), ["__group", "__time"], list(numeric), list(categorical), "g_")
    donors = measured_side(donors.withColumnsRenamed({f"n_{f}": f"d_{f}" for f in fields}), "donors")
    full = rows.join(near, ["__entity", "__time"], "left").join(donors, ["__group", "__time"], "left")  # NULL keys have neither

    out = [F.col("__record").alias(record)]
    for f in fields:
        own, prev, after = F.col(f), F.col(f"prev_{f}"), F.col(f"next_{f}")
        back, ahead = F.col("__time") - prev["at"], after["at"] - F.col("__time")
        nearest = F.when(prev.isNotNull() & (back <= max_gap) & (after.isNull() | (back <= ahead)), F.struct(prev["value"].alias("v"), back.alias("d"))).when(after.isNotNull() & (ahead <= max_gap), F.struct(after["value"].alias("v"), ahead.alias("d")))
        donated = F.when(F.col(f"g_{f}").isNotNull(), F.struct(F.col(f"g_{f}").alias("v"), F.lit(0).cast("bigint").alias("d")))
        between = F.when(prev.isNotNull() & after.isNotNull(), F.struct((prev["value"] + (after["value"] - prev["value"]) * back / (back + ahead)).alias("v"), F.least(back, ahead).alias("d"))) if f in numeric else F.lit(None)
        steps = [("interpolated", between), ("group", donated), ("carried", nearest)] if f in numeric else [("carried", nearest), ("group", donated)]
        method, value, distance = F.when(own.isNotNull(), "observed"), F.when(own.isNotNull(), own), F.when(own.isNotNull(), F.lit(0).cast("bigint"))
        for name, source in steps:
            method, value, distance = method.when(source.isNotNull(), name), value.when(source.isNotNull(), source["v"]), distance.when(source.isNotNull(), source["d"].cast("bigint"))
        out += [value.alias(f), method.otherwise("none").alias(f"{f}_method"), distance.alias(f"{f}_distance"), F.coalesce(f"d_{f}", F.lit(0)).alias(f"{f}_donors")]
    return full.select(*out)


def filled_long(filled: DataFrame, record: str, numeric: Sequence[str], categorical: Sequence[str], table_name: str) -> DataFrame:
    """The result of fill_missing with one row per record and field, the value in `number` or in `text`."""
    value = lambda f: (F.lit(f).alias("field_name"), (F.col(f) if f in numeric else F.lit(None)).cast("double").alias("number"), (F.col(f) if f in categorical else F.lit(None)).cast("string").alias("text"))
    items = F.array(*(F.struct(*value(f), F.col(f"{f}_method").alias("method"), F.col(f"{f}_distance").alias("distance"), F.col(f"{f}_donors").alias("donors")) for f in (*numeric, *categorical)))
    return filled.select(F.lit(table_name).alias("table_name"), record, F.inline(items))
