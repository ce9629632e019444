"""Exact profiles of the columns of a table, load by load, and what moved between loads.

The base is one table of value counts: the columns are unpivoted and counted by load, column and value. Partial
aggregation takes frequent values out before the shuffle, and everything else (frequencies, distinct counts,
ranges, quantiles, pattern violations, drift) is computed from that smaller table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import distinct_rows, safe_ratio
from tidemark.plans.ordered import ROWS_PER_BUCKET, quantiles_of_counts
from tidemark.plans.staging import join_same, measured_side, stage, stage_counted

QUARTILES = (0.25, 0.5, 0.75)
DECILES = tuple(i / 10 for i in range(1, 10))
#: Whole numbers with at most so many different values in the load before are compared value by value and not by classes.
FEW_VALUES = 20


@dataclass(frozen=True)
class Rule:
    """What a column's values must keep to: bounds, each a number or the name of another column, and a pattern for the whole text."""

    low: float | str | None = None
    high: float | str | None = None
    pattern: str | None = None

    def needs(self) -> list[str]:
        return [b for b in (self.low, self.high) if isinstance(b, str)]


def _slots(df: DataFrame, name: str) -> dict[str, Column]:
    """The value in the slot of its kind: num for floating, whole for exact numbers and times, txt for the rest."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    num, whole, txt = F.lit(None).cast("double"), F.lit(None).cast("bigint"), F.lit(None).cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        num = c.cast("double")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        whole = c.cast("bigint")
    elif isinstance(kind, T.BooleanType):
        whole = c.cast("int").cast("bigint")
    elif isinstance(kind, T.DateType):
        whole = F.unix_date(c).cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        txt = F.to_json(c)
    else:
        txt = c.cast("string")
    return {"num": num, "whole": whole, "txt": txt}


def _outside(df: DataFrame, name: str, rule: Rule | None) -> Column:
    if rule is None or (rule.low is None and rule.high is None):
        return F.lit(False)
    value = F.col(f"`{name}`").cast("double")
    bound = lambda b: F.col(f"`{b}`").cast("double") if isinstance(b, str) else F.lit(float(b))
    broken = F.lit(False)
    if rule.low is not None:
        broken = broken | (value < bound(rule.low))
    if rule.high is not None:
        broken = broken | (value > bound(rule.high))
    return F.coalesce(broken & ~F.isnan(value), F.lit(False))


def value_counts(df: DataFrame, load: str, columns: Sequence[str], rules: Mapping[str, Rule] | None = None, repeats_once: bool = True) -> DataFrame:
    """One row (`load`, column_name, num, whole, txt, n, n_outside) per load, column and value.

    Missing values are one row with all slots NULL, NaN is one with num NaN. With `repeats_once`, rows equal in
    all columns of the table count once.
    """
    rules = rules or {}
    keep = list(dict.fromkeys([load, *columns, *(b for r in rules.values() for b in r.needs())]))
    rows = distinct_rows(df, keep) if repeats_once else df.select(*(F.col(f"`{c}`") for c in keep))
    items = F.array(*(F.struct(F.lit(i).alias("__column"), *(v.alias(k) for k, v in _slots(df, c).items()), _outside(df, c, rules.get(c)).alias("outside")) for i, c in enumerate(columns)))
    long = rows.select(F.col(f"`{load}`").alias("__load"), F.inline(items))
    counts = long.groupBy("__load", "__column", "num", "whole", "txt").agg(F.count(F.lit(1)).alias("n"), F.count_if("outside").alias("n_outside"))
    name = F.get(F.array(*(F.lit(c) for c in columns)), F.col("__column"))  # a number is shuffled, not the name
    return counts.select(F.col("__load").alias(load), name.alias("column_name"), "num", "whole", "txt", "n", "n_outside")


def _nan() -> Column:
    return F.coalesce(F.isnan("num"), F.lit(False))


def _null() -> Column:
    return F.col("num").isNull() & F.col("whole").isNull() & F.col("txt").isNull()


def column_stats(counts: DataFrame, load: str, rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """One row per load and column: rows, nulls, nans, distinct measured values, ranges by kind, values outside the rule's bounds, values that break its pattern."""
    broken = F.lit(0)
    for name, rule in (rules or {}).items():
        if rule.pattern:
            broken = F.when((F.col("column_name") == name) & ~F.col("txt").rlike(f"^(?:{rule.pattern})\\z"), F.col("n")).otherwise(broken)
    ok = ~_null() & ~_nan()
    return counts.groupBy(load, "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(_null(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(_nan(), F.col("n")).otherwise(0)).alias("n_nan"),
        F.count_if(ok).alias("n_distinct"),
        F.min(F.when(ok, F.col("num"))).alias("min_num"),
        F.max(F.when(ok, F.col("num"))).alias("max_num"),
        F.min("whole").alias("min_whole"),
        F.max("whole").alias("max_whole"),
        F.min("txt").alias("min_txt"),
        F.max("txt").alias("max_txt"),
        F.max(F.when(ok, F.col("n"))).alias("n_most_frequent"),
        F.sum("n_outside").alias("n_outside"),
        F.sum(broken).alias("n_pattern"),
    )


def exact_quantiles(counts: DataFrame, load: str, stats: DataFrame, probs: Sequence[float] = QUARTILES, rows_per_bucket: int = ROWS_PER_BUCKET, most: int | None = None) -> DataFrame:
    """One row (`load`, column_name, quantiles ARRAY<DOUBLE>) per load and numeric column with a measured value.

    Linear interpolation between the neighbouring ranks. Ranks come from running sums over the value counts, in
    buckets where a load is too large for one task, so no group is ever gathered.
    """
    numeric = counts.filter((F.col("num").isNotNull() & ~_nan()) | F.col("whole").isNotNull())
    values = numeric.select(load, "column_name", F.coalesce("num", F.col("whole").cast("double")).alias("__v"), "n")
    totals = stats.select(load, "column_name", (F.col("n_rows") - F.col("n_null") - F.col("n_nan")).alias("total"), F.col("n_distinct").alias("rows"))
    return quantiles_of_counts(values, [load, "column_name"], "__v", "n", totals, probs, rows_per_bucket, most)


def profile(df: DataFrame, load: str, columns: Sequence[str], rules: Mapping[str, Rule] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """column_stats and quartiles of each load and column.

    An empty table gives no rows; a column that is always NULL has n_distinct 0 and NULL ranges; loads that are
    NULL form a load of their own. Extra columns are ignored but for telling repeats from rows that differ.
    """
    counts, most = stage_counted(value_counts(df, load, columns, rules), "value_counts")
    return profile_of_counts(counts, load, rules, rows_per_bucket=rows_per_bucket, most=most)


def profile_of_counts(counts: DataFrame, load: str, rules: Mapping[str, Rule] | None, classes: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET, most: int | None = None) -> DataFrame:
    """column_stats with `quantiles`, the quartiles; with `classes` also `edges`, the deciles that drift compares by."""
    stats = stage(column_stats(counts, load, rules), "column_stats")
    probs = [*QUARTILES, *DECILES] if classes else QUARTILES
    found = exact_quantiles(counts, load, stats, probs, rows_per_bucket, most)
    if classes:
        edges = F.array_distinct(F.slice("quantiles", len(QUARTILES) + 1, len(DECILES)))
        found = found.select(load, "column_name", F.slice("quantiles", 1, len(QUARTILES)).alias("quantiles"), edges.alias("edges"))
    return join_same(stats, found, [load, "column_name"], "left")


def findings(profiled: DataFrame, load: str, null_step: float = 0.10, distinct_factor: float = 2.0, shift_factor: float = 1.5) -> DataFrame:
    """Rows (`load`, column_name, finding) with range, pattern, nulls, distinct or shift, against the load with the next lower number.

    The share of unmeasured rows is compared in whole numbers of hundredths, so a step of exactly `null_step` is
    none. A quartile that is absent on either side has not shifted.
    """
    before = Window.partitionBy("column_name").orderBy(load)
    gone = F.col("n_null") + F.col("n_nan")
    seen = profiled.filter(F.col(load).isNotNull()).select("*", gone.alias("gone"), F.lag("n_rows").over(before).alias("p_rows"), F.lag(gone).over(before).alias("p_gone"), F.lag("n_distinct").over(before).alias("p_distinct"), F.lag("quantiles").over(before).alias("p_quantiles"))
    step = F.abs(F.col("gone") * F.col("p_rows") - F.col("p_gone") * F.col("n_rows")) * 1000 > F.col("n_rows") * F.col("p_rows") * round(null_step * 1000)
    moved = F.exists(F.arrays_zip(F.col("quantiles").alias("q"), F.col("p_quantiles").alias("p")), lambda z: (F.abs(z["q"]) > F.abs(z["p"]) * shift_factor) | (F.abs(z["q"]) * shift_factor < F.abs(z["p"])))
    cases = F.filter(
        F.array(
            F.when(F.col("n_outside") > 0, "range"),
            F.when(F.col("n_pattern") > 0, "pattern"),
            F.when(step, "nulls"),
            F.when((F.col("n_distinct") > F.col("p_distinct") * distinct_factor) | (F.col("n_distinct") * distinct_factor < F.col("p_distinct")), "distinct"),
            F.when(F.col("quantiles").isNotNull() & F.col("p_quantiles").isNotNull() & moved, "shift"),
        ),
        lambda x: x.isNotNull(),
    )
    return seen.select(load, "column_name", F.explode(cases).alias("finding"))


def drift(counts: DataFrame, load: str, profiled: DataFrame) -> DataFrame:
    """Population stability index and chi-square of each load and column against the load with the next lower number.

    Classes are those of the load before: texts are compared value by value, and so are whole numbers that had at most
    FEW_VALUES different ones there; other numbers by its deciles (`edges` of profile_of_counts; with a plain profile
    its quartiles), equal ones being one edge. A value v falls into the class of the edges below it. Missing values are a
    class of their own, and so are numbers in a column that had none measured before. Both sides are tagged and
    summed in one grouping. A class absent on one side counts as half a row there, as is usual for the index.
    Columns are (`load`, column_name, n_classes, psi, chi_square); the first load and loads that are NULL have no row.
    """
    edges = "edges" if "edges" in profiled.columns else "quantiles"
    numbers = profiled.select(load).distinct().filter(F.col(load).isNotNull())
    line = Window.orderBy(load)  # one row a load
    steps = measured_side(numbers.select(F.col(load).alias("__at"), F.lead(load).over(line).alias("__next"), (F.row_number().over(line) == 1).alias("__first")), "steps")
    sides = F.array(F.struct(F.when(~F.col("__first"), F.col("__at")).alias("step"), F.lit(True).alias("now")), F.struct(F.col("__next").alias("step"), F.lit(False).alias("now")))
    tagged = counts.join(steps, F.col(load) == F.col("__at")).select("column_name", "num", "whole", "txt", "n", F.inline(F.filter(sides, lambda s: s["step"].isNotNull())))
    past = profiled.join(steps.withColumnRenamed("__next", "__step"), F.col(load) == F.col("__at")).filter("__step IS NOT NULL")
    past = past.select(F.col("__step"), F.col("column_name").alias("__c"), F.col(edges).alias("__edges"), (F.col("min_whole").isNotNull() & (F.col("n_distinct") <= FEW_VALUES)).alias("__few"))
    edged = tagged.join(measured_side(past, "edges"), (F.col("step") == F.col("__step")) & (F.col("column_name") == F.col("__c")), "left")
    value = F.coalesce("num", F.col("whole").cast("double"))
    below = sum((F.when(F.get("__edges", F.lit(i)) < value, 1).otherwise(0) for i in range(len(DECILES))), F.lit(0)).cast("string")
    label = F.when(_null() | _nan(), "missing").when(F.col("txt").isNotNull(), F.concat(F.lit("="), "txt"))
    label = label.when(F.col("__few") & F.col("whole").isNotNull(), F.concat(F.lit("="), F.col("whole").cast("string"))).when(F.col("__edges").isNotNull(), F.concat(F.lit("above "), below)).otherwise("new")
    side = lambda now: F.coalesce(F.sum(F.when(F.col("now") == F.lit(now), F.col("n"))), F.lit(0))
    classes = edged.select("step", "column_name", "now", "n", label.alias("label")).groupBy("step", "column_name", "label").agg(side(True).alias("a"), side(False).alias("b"))
    classes = stage(classes, "classes")
    totals = classes.groupBy("step", "column_name").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = join_same(classes, measured_side(totals, "totals"), ["step", "column_name"])
    a, b = (F.greatest(c, F.lit(0.5)) for c in ("a", "b"))
    pa, pb = safe_ratio(a, F.col("ta")), safe_ratio(b, F.col("tb"))
    expected = b * safe_ratio(F.col("ta"), F.col("tb"))
    return shares.groupBy(F.col("step").alias(load), "column_name").agg(F.count(F.lit(1)).alias("n_classes"), F.sum((pa - pb) * F.ln(pa / pb)).alias("psi"), F.sum((F.col("a") - expected) * (F.col("a") - expected) / expected).alias("chi_square"))
