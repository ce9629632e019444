"""Composite index of min-max scaled indicators, its coverage, and how its top ranks hold under perturbed weights."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import measured, safe_ratio
from tidemark.plans.ordered import count_up_to
from tidemark.plans.staging import stage

#: Fixed value: share of the draws in which a unit must be among the first for its rank to count as robust.
ROBUST = 0.8


def check_weights(weights: Mapping[str, float], columns: Sequence[str], perturbed: bool = False) -> dict[str, float]:
    """The weights of the columns that are there; refused if none, negative, all zero, or zero where it is to be perturbed."""
    there = {k: float(w) for k, w in weights.items() if k in columns}
    if not there or any(w < 0 for w in there.values()) or not sum(there.values()):
        raise ValueError(f"weights must be for known columns, not negative and not all zero: {dict(weights)}")
    if perturbed and 0.0 in there.values():
        raise ValueError("a weight of 0 can't be perturbed")
    return there


def indicator_bounds(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Least and largest measured value of each indicator, as columns low_<name> and high_<name>."""
    return df.groupBy(*by).agg(*(f(measured(F.col(n).cast("double"))).alias(f"{p}_{n}") for n in names for p, f in (("low", F.min), ("high", F.max))))


def scaled(name: str) -> Column:
    """0 to 1 between the bounds, clipped; 0 for a constant indicator; NULL stays NULL."""
    v, low, spread = measured(F.col(name).cast("double")), F.col(f"low_{name}"), F.col(f"high_{name}") - F.col(f"low_{name}")
    return F.when(v.isNull(), None).when(spread == 0, 0.0).otherwise(F.least(F.greatest((v - low) / spread, F.lit(0.0)), F.lit(1.0)))


def weighted_mean(parts: Mapping[str, Column], weights: Mapping[str, Column]) -> Column:
    """Mean over the parts that are measured, by their weights; NULL if none is."""
    top = sum((F.coalesce(parts[k] * weights[k], F.lit(0.0)) for k in parts), F.lit(0.0))
    bottom = sum((F.when(parts[k].isNotNull(), weights[k]).otherwise(0.0) for k in parts), F.lit(0.0))
    return safe_ratio(top, bottom)


def composite_index(df: DataFrame, weights: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """`df` with `vulnerability` and `indicator_coverage`; bounds are those of the table, or of each group of `by`.

    The bounds are one row (or one per group) and are joined back; min and max are reduced on the map side.
    """
    weights = check_weights(weights, df.columns)
    bounds = indicator_bounds(df, list(weights), by)
    joined = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))  # the bounds of a whole table are one row
    fixed = {k: F.lit(w) for k, w in weights.items()}
    coverage = sum((F.when(measured(F.col(k).cast("double")).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    out = joined.withColumns({"vulnerability": weighted_mean({k: scaled(k) for k in weights}, fixed), "indicator_coverage": coverage})
    return out.drop(*bounds.columns[len(by) :])


def pessimistic_rank(value: Column, partition: Sequence[str | Column]) -> Column:
    """Rank from the largest down where equal values all take the last of their ranks; NULL is unranked."""
    line = Window.partitionBy(*partition).orderBy(value.desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(value.isNotNull(), F.count(F.lit(1)).over(line))


def pessimistic_ranks(df: DataFrame, by: Sequence[str], value: str, out: str = "pessimistic_rank") -> DataFrame:
    """pessimistic_rank as a column, for groups of any size: the number of rows that are at least as large, by running sums over value counts."""
    down = df.withColumn("__down", -measured(F.col(value).cast("double")))
    return count_up_to(down, by, "__down", out).drop("__down")


def draw_weights(weights: Mapping[str, float], perturbation: float, draws: int, seed: int) -> list[list[float]]:
    """Weights of each draw, each times 1 plus a uniform number up to the perturbation either way; draw by draw, in the order of the indicators."""
    random = np.random.default_rng(seed)
    return [[float(w * (1 + random.uniform(-perturbation, perturbation))) for w in weights.values()] for _ in range(draws)]


def rank_stability(df: DataFrame, key: str, weights: Mapping[str, float], perturbation: float = 0.3, draws: int = 200, top: int = 10, seed: int = 0) -> DataFrame:
    """key, vulnerability, indicator_coverage, top_n_frequency and confidence of every unit.

    Instead of ranking all units in every draw, a draw only needs its `top`-th score: a unit hits if its pessimistic
    rank is within top, that is if fewer than top + 1 units score at least as much. So every task keeps, for
    each draw, its `top` + 1 largest scores, the final aggregation merges these short lists, and one row of thresholds
    per draw decides all hits in a second pass. Nothing is sorted or shuffled by draw, and the memory of the
    aggregation is draws x (top + 1) numbers whatever the number of units.
    """
    weights = check_weights(weights, df.columns, perturbed=True)
    names = list(weights)
    df = stage(df.select(key, *names), "units")
    bounds = indicator_bounds(df, names)
    table = draw_weights(weights, perturbation, draws, seed)
    base = df.crossJoin(F.broadcast(bounds)).select(key, *(scaled(n).alias(f"s_{n}") for n in names), *(F.col(f"{p}_{n}") for n in names for p in ("low", "high")))  # bounds are one row
    parts = {n: F.col(f"s_{n}") for n in names}
    merged = base.select(*(F.col(f"s_{n}") for n in names)).mapInArrow(_keep_largest(table, top), "draw int, score double")
    line = Window.partitionBy("draw").orderBy(F.desc("score"))
    cut = merged.withColumn("__n", F.row_number().over(line)).where(F.col("__n") <= top + 1).groupBy("draw").agg(F.max(F.when(F.col("__n") == top, F.col("score"))).alias("last"), F.max(F.when(F.col("__n") == top + 1, F.col("score"))).alias("next"))
    # a tie across the border takes the last rank of the tie, so only scores above it are in; with fewer than top units all are
    above, start = np.full(draws, np.inf), np.full(draws, np.inf)
    for row in cut.collect():  # one row per draw
        if row["last"] is None:
            start[row["draw"]] = -np.inf
        elif row["next"] == row["last"]:
            above[row["draw"]] = row["last"]
        else:
            start[row["draw"]] = row["last"]
    shape = T.StructType([*base.schema, T.StructField("__hits", T.IntegerType())])
    joined = base.mapInArrow(_count_hits([f"s_{n}" for n in names], table, above, start), shape)
    fixed = {n: F.lit(w) for n, w in weights.items()}
    coverage = sum((F.when(parts[n].isNotNull(), w).otherwise(0.0) for n, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    spread = F.greatest(*(F.coalesce(F.col(f"high_{n}") - F.col(f"low_{n}"), F.lit(0.0)) for n in names)) if len(names) > 1 else F.coalesce(F.col(f"high_{names[0]}") - F.col(f"low_{names[0]}"), F.lit(0.0))
    measured_rows = joined.select(key, weighted_mean(parts, fixed).alias("vulnerability"), coverage.alias("indicator_coverage"), F.when(spread > 0, F.col("__hits") / F.lit(float(draws))).otherwise(0.0).alias("top_n_frequency"), (spread > 0).alias("__spread"))
    robust = F.col("top_n_frequency") >= ROBUST
    confidence = F.when(F.col("indicator_coverage") <= 0, "not_measured").when(~F.col("__spread"), "no_discrimination").when(F.lit(len(names) < 2), "single_indicator").when(robust & (F.col("indicator_coverage") >= 1), "robust").when(robust, "partial_indicators").otherwise("indicative")
    return measured_rows.withColumn("confidence", confidence).drop("__spread")


def _scores(batch: pa.RecordBatch, names: Sequence[str], weights: np.ndarray) -> np.ndarray:
    """Mean of the scaled values by each draw's weights, units by draws; -inf for a unit without any value."""
    values = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype("float64") for n in names])
    have = ~np.isnan(values)
    total, bottom = np.zeros((2, len(values), len(weights)))
    for i in range(values.shape[1]):
        bottom += have[:, i : i + 1] * weights[:, i]
        total += np.where(have[:, i : i + 1], np.nan_to_num(values[:, i : i + 1]) * weights[:, i], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(bottom > 0, total / bottom, -np.inf)


def _keep_largest(table: Sequence[Sequence[float]], top: int):
    """For each draw, the top + 1 largest scores of a partition; batches are reduced as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(table)
        best = np.full((len(table), top + 1), -np.inf)
        for batch in batches:
            both = np.concatenate([best, _scores(batch, batch.schema.names, weights).T], axis=1)
            best = -np.partition(-both, top, axis=1)[:, : top + 1]
        draws, places = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(draws.astype(np.int32)), pa.array(best[draws, places])], names=["draw", "score"])

    return run


def _count_hits(names: Sequence[str], table: Sequence[Sequence[float]], above: np.ndarray, start: np.ndarray):
    """The batches with the number of draws in which a unit scores above one limit or at least another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(table)
        for batch in batches:
            scores = _scores(batch, names, weights)
            hits = (np.isfinite(scores) & ((scores > above) | (scores >= start))).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits)], names=[*batch.schema.names, "__hits"])

    return run
