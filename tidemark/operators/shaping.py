"""Class breaks, pivots, first rows, slices of a ranking, and encoding of rows as compact text under a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import measured
from tidemark.plans.ordered import numbered, running_sum
from tidemark.plans.staging import join_same, measured_side, stage_counted


def quantile_classes(df: DataFrame, value: str, classes: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """`df` with `breaks` (nearest-rank upper bounds, duplicates collapsed) and `class` of the value, from 0; NULL where it isn't measured.

    The breaks are values that occur. They are one row per group, joined back; counts by value make the group small first.
    """
    v = measured(F.col(value).cast("double"))
    counted, most = stage_counted(df.where(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count(F.lit(1)).alias("__n")), "value_counts")
    totals = measured_side(counted.groupBy(*by).agg(F.sum("__n").alias("__all")), "totals")
    ranked = running_sum(counted, list(by), ["__v"], "__n", "__below", most)
    ranked = join_same(ranked, totals, by) if by else ranked.crossJoin(totals)  # one row
    ranks = F.array(*(F.greatest(F.ceil(F.lit(i) / classes * F.col("__all")) - 1, F.lit(0)) for i in range(1, classes + 1)))
    chosen = ranked.where(F.exists(ranks, lambda r: (F.col("__below") <= r) & (r < F.col("__below") + F.col("__n"))))
    breaks = measured_side(chosen.groupBy(*by).agg(F.sort_array(F.collect_set("__v")).alias("breaks")), "breaks")
    joined = join_same(df, breaks, by, "left") if by else df.join(F.broadcast(breaks), F.lit(True), "left")
    below = F.size(F.filter("breaks", lambda b: b < v))
    return joined.withColumn("class", F.when(v.isNotNull(), F.least(below, F.size("breaks") - 1)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    line = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(line)).where("__rn = 1").drop("__rn")


def bottom_share(df: DataFrame, by: Sequence[str], score: str, tie: str, share: float, most: int | None = None) -> DataFrame:
    """The tail of each ranking from the largest `score` down: rows from place int(n * (1 - share)), counted from 0; `model_rank` counts from 1.

    Equal scores are ordered by `tie`, rows without a score come last. With `most`, ValueError if the tail of a ranking has
    more rows than that: the callers look every one up, so a part of it would pass for the whole. Places come from
    running counts over buckets of the ranking, so no group is held by one task.
    """
    sizes = measured_side(df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")), "sizes")
    if most is not None and (over := sizes.where(F.col("rows") - F.floor(F.col("rows") * F.lit(1 - share)) > most).first()) is not None:
        raise ValueError(f"the lower {share:.0%} of {over} are more than {most} rows")
    down = df.withColumns({"__down": F.coalesce(-measured(F.col(score).cast("double")), F.lit(float("inf")))})
    placed = numbered(down, by, ["__down", tie], "model_rank", sizes).drop("__down")
    return join_same(placed, sizes, by).where(F.col("model_rank") > F.floor(F.col("rows") * F.lit(1 - share))).drop("rows")


def pivot_counts(df: DataFrame, row: str, column: str, columns: Sequence[object], item: str) -> DataFrame:
    """Distinct items per row and column of a given list, with a total over the columns shown; an item counts once per cell."""
    cells = df.groupBy(row).agg(*(F.count_distinct(F.when(F.col(column) == F.lit(c), F.col(item))).alias(str(c)) for c in columns))
    return cells.withColumn("total", sum((F.col(f"`{c}`") for c in columns), F.lit(0)))


def cell_text(field: T.StructField) -> Column:
    """A value as a token: null, true, a number without noise (at most 4 decimals, half to even), or text, quoted where it could be misread."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BooleanType):
        text = c.cast("string")
    elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        rounded = F.bround(d, 4)
        short = F.regexp_replace(F.format_string("%.4f", rounded), r"0+$", "")
        text = F.when(F.isnan(d), None).when(d == F.floor(d), d.cast("bigint").cast("string")).otherwise(F.when(short.endswith("."), F.concat(short, F.lit("0"))).otherwise(short))
    elif isinstance(field.dataType, T.NumericType):
        text = c.cast("string")
    else:
        s = c.cast("string")
        special = s.rlike(r'[,:"\n\\\[\]{}]|^\s|\s$|^$') | s.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$|^(true|false|null)$")
        quoted = F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
        text = F.when(special, quoted).otherwise(s)
    return F.coalesce(text, F.lit("null"))


def toon_lines(df: DataFrame) -> Column:
    return F.concat(F.lit("  "), F.concat_ws(",", *(cell_text(f) for f in df.schema)))


def toon_header(names: Sequence[str], title: str, n: Column) -> Column:
    return F.concat(F.lit(f"{title}["), n.cast("string"), F.lit("]{" + ",".join(names) + "}:"))


def toon_budget(df: DataFrame, order: str, columns: Sequence[str], title: str, most: int) -> DataFrame:
    """The longest head of the rows by `order` whose text, header with its row count included, has at most `most` characters: (ordinal, line, chars).

    `order` is a unique number. Running sums give the size of every head at once, so nothing is searched for.
    """
    shown = df.select(*columns)
    lines = df.select(F.col(order).alias("__o"), toon_lines(shown).alias("line")).withColumns({"__c": F.length("line").cast("bigint") + 1, "__one": F.lit(1)})
    summed = running_sum(running_sum(lines, [], ["__o"], "__c", "__before"), [], ["__o"], "__one", "ordinal")
    n = F.col("ordinal") + 1
    chars = F.col("__before") + F.col("__c") + F.length(toon_header(columns, title, n))
    return summed.select("ordinal", "line", chars.alias("chars")).where(F.col("chars") <= most)


def flatten(df: DataFrame, separator: str = "_", drop: Sequence[str] = ("geometry",)) -> DataFrame:
    """Nested structs as parent_child columns; lists and maps are refused, geometry is dropped."""
    out: list[Column] = []

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind:
            here = [*path, f.name]
            if f.name in drop:
                continue
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                raise ValueError(f"a list in {'.'.join(here)}: explode it first")
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))

    walk(df.schema, [])
    return df.select(*out)
