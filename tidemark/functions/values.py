"""Expressions under which NULL means "not measured" and is never confused with zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.staging import measured_side


def measured(column: Column | str, kind: T.DataType | None = None) -> Column:
    """The value, or NULL where it is NaN."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c) if kind is None or isinstance(kind, (T.DoubleType, T.FloatType)) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """`df` with NaN made NULL in every floating column, so that comparisons and sums obey SQL's rules."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: measured(c) for c in floating})


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; NULL where either is NULL or bottom is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def trimmed(column: Column | str) -> Column:
    """The text without Unicode white space around it."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def identifier(column: Column | str) -> Column:
    """The text in lower case without white space around it."""
    return F.lower(trimmed(column))


def hashable(df: DataFrame, column: str) -> Column:
    """`column` in a form that xxhash64 takes: maps and variants as JSON."""
    kind = df.schema[column].dataType
    quoted = F.col(f"`{column}`")
    return F.to_json(quoted) if "map<" in kind.simpleString() else quoted


def row_hash(columns: Sequence[Column], seed: int = 0) -> Column:
    """64 bits of the values in order; a NULL differs from every value and from a NULL elsewhere, as the places of NULLs go in as bits."""
    words = []
    for at in range(0, len(columns), 60):
        word = F.lit(0).cast("bigint")
        for i, c in enumerate(columns[at : at + 60]):
            word = word + F.when(c.isNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        words.append(word)
    return F.xxhash64(F.lit(seed), *words, *columns)


def distinct_rows(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Columns `keep` of the distinct rows of `df`; rows count as equal if all their columns are, NaN equal to NaN.

    Rows are known by fingerprints of 128 bits of all their columns. Those that occur again are found on the
    fingerprints alone, counted before the shuffle; of these rows one each is kept, and all others pass without being
    shuffled. Names that clash with the fingerprint's own are not expected; all others are carried as they are.
    """
    everything = [hashable(df, c) for c in df.columns]
    kept = [F.col(f"`{c}`") for c in keep]
    marked = df.select(*kept, row_hash(everything).alias("__fp_a"), row_hash(everything[::-1], 1).alias("__fp_b"))
    again = marked.groupBy("__fp_a", "__fp_b").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    again = measured_side(again, "repeats")
    single = marked.join(again, ["__fp_a", "__fp_b"], "left_anti").select(*kept)
    one = marked.join(again, ["__fp_a", "__fp_b"], "left_semi").dropDuplicates(["__fp_a", "__fp_b"]).select(*kept)
    return single.unionByName(one)
