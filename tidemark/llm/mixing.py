"""Sources mixed to target shares of the total size: budgets met by counts per exact length."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import identifier, safe_ratio
from tidemark.plans.ordered import ROWS_PER_BUCKET, running_sum
from tidemark.plans.staging import join_same, measured_side, stage

#: States (sums) that one search may hold; 5 bytes each.
SEARCH_STATES = 1 << 24


def _steps(lengths: list[int], free: dict[int, int]) -> Iterator[tuple[int, int]]:
    """(length, copies) such that every number of copies up to the free ones is a sum of some steps."""
    for n in lengths:
        rest, copies = free[n], 1
        while rest > 0:
            copies = min(copies, rest)
            yield n, copies
            rest, copies = rest - copies, copies * 2


def _reach(lengths: list[int], add: dict[int, int], drop: dict[int, int], back: int, left: int) -> tuple[int, dict[int, int]]:
    """The largest sum from 0 to `left` of lengths added and dropped, no intermediate sum being below -back, and how many of each to add.

    A bounded knapsack over the sums from -back to left: all drops first, then all adds, each step noted at the sums
    it reaches first, which is enough to walk back. It ends once `left` itself is reached.
    """
    seen = np.zeros(back + left + 1, dtype=bool)
    first = np.full(back + left + 1, -1, dtype=np.int32)
    seen[back] = True
    steps: list[tuple[int, int]] = []

    def step(n: int, copies: int, sign: int) -> None:
        by = n * copies
        if by >= len(seen):
            return
        fresh = seen[by:] & ~seen[:-by] if sign < 0 else seen[:-by] & ~seen[by:]
        at = np.flatnonzero(fresh) + (0 if sign < 0 else by)
        if len(at):
            seen[at], first[at] = True, len(steps)
            steps.append((n, sign * copies))

    for n, copies in _steps(lengths, {n: min(c, back // n) for n, c in drop.items()}):
        step(n, copies, -1)
    for n, copies in _steps(lengths, {n: min(c, (back + left) // n) for n, c in add.items()}):
        if seen[-1]:
            break
        step(n, copies, 1)
    best = at = back + int(np.flatnonzero(seen[back:])[-1])
    change: dict[int, int] = {}
    while at != back:
        n, copies = steps[first[at]]
        change[n] = change.get(n, 0) + copies
        at -= n * copies
    return best - back, change


def best_subset(counts: dict[int, int], budget: int, seed: int, states: int = SEARCH_STATES) -> tuple[dict[int, int], bool]:
    """How many items of each length to take so that their sum comes as near to `budget` as it can from below, and whether that is proved.

    The same share of every length first, rounded down, so the choice keeps the source's spread of lengths; then
    single items in seeded order. A bounded knapsack closes what is left: it may add free items and give back taken
    ones, first a few tokens' worth, then twice as many, until the budget itself is reached or nothing better can
    be. Let L be the largest length. What remains is below L, so a best choice that differs least from the
    first has under 3 L items exchanged (of a longer list, ordered so that its sums stay within L, some part
    would sum to 0 and could be left out); those given back are worth less than 2 L x L. A search that far back
    is therefore exact, as is one that may give back everything. `states` bounds the sums that are held; only
    where an exact search needs more is the result unproved, and the budget is then missed by less than one
    item's length.
    """
    lengths = sorted(n for n, c in counts.items() if n > 0 and c > 0)
    total = sum(n * counts[n] for n in lengths)
    if budget >= total:
        return dict(counts), True
    taken = {n: c * budget // total if n > 0 else 0 for n, c in counts.items()}
    left = budget - sum(n * c for n, c in taken.items())
    random.Random(seed).shuffle(lengths)
    for n in lengths:
        more = min(1, counts[n] - taken[n], left // n)
        taken[n] += more
        left -= n * more
    for n in sorted(lengths, reverse=True):
        more = min(counts[n] - taken[n], left // n)
        taken[n] += more
        left -= n * more
    unit, largest = math.gcd(*lengths), max(lengths)
    short = left // unit
    scaled = [n // unit for n in lengths]
    need = min(sum(n * taken[n] for n in lengths) // unit, 2 * (largest // unit) ** 2)
    back, best = 0, (0, {})
    while short and min(back, need) <= states - short - 1:
        got, change = _reach(scaled, {n // unit: counts[n] - taken[n] for n in lengths}, {n // unit: taken[n] for n in lengths}, min(back, need), short)
        if got == short or back >= need:
            for n, more in change.items():
                taken[n * unit] += more
            return taken, True
        best = got, change
        back = max(2 * back, largest // unit)
    if short:
        for n, more in best[1].items():
            taken[n * unit] += more
    return taken, not short


def fit_subset(counts: dict[int, int], budget: int, seed: int, states: int = SEARCH_STATES) -> dict[int, int]:
    """The first part of best_subset."""
    return best_subset(counts, budget, seed, states)[0]


@dataclass(frozen=True)
class Mixture:
    """shares: one row per mix and source with what was asked and reached; chosen: (mix, item, source, tokens, copies), planned when it is asked for."""

    choose: Callable[[], DataFrame]
    shares: DataFrame

    @property
    def chosen(self) -> DataFrame:
        return self.choose()


def mix_sources(docs: DataFrame, item: str, source: str, size: Column, targets: DataFrame, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET, states: int = SEARCH_STATES) -> Mixture:
    """Items combined so that each source of a mix has its target share of the mix's size.

    `targets` has mix_id, source, target_share, max_repeats. The size of a mix is that of all sources it names,
    each item once; a source's budget is its share of that. A budget under one pass over the source is met by a
    subset, a larger one by whole passes and a subset, and a source whose passes run out (`max_repeats`) before its
    share is reached falls short, which the report says from what the plan reached. Sources are compared in lower
    case without white space around them; items without a source belong to none, and a source without items has
    size 0. Several rows of one mix and source are one: shares add up, the larger max_repeats counts. NULL shares
    and repeats count as 0. Empty and NULL items have size 0; they are taken with each whole pass and never to
    fill a budget.

    The histogram of lengths is planned mix by source, in parallel tasks that hold one source's distinct lengths and
    at most `states` sums each; `proved` in the report says that no choice comes nearer to the budget (best_subset).
    Which items of a length are taken follows a seeded order, the same in every mix.
    """
    sizes = stage(docs.select(F.col(item).alias("item"), identifier(source).alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("tokens")).filter("source IS NOT NULL"), "sizes")
    histogram = stage(sizes.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("rows")), "histogram")
    available = histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("rows")).alias("available"))
    wanted = targets.select("mix_id", F.col("source").alias("given"), identifier("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    wanted = wanted.groupBy("mix_id", "source").agg(F.min("given").alias("given"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = stage(join_same(wanted, available, ["source"], "left").withColumn("available", F.coalesce("available", F.lit(0))), "wanted")
    whole = wanted.groupBy("mix_id").agg(F.sum("available").alias("mix_tokens"))
    asked = stage(join_same(wanted, whole, ["mix_id"]).withColumn("budget", F.floor(F.col("target_share") * F.col("mix_tokens"))), "asked")

    def planned(rows: pd.DataFrame) -> pd.DataFrame:
        budget, repeats = int(rows["budget"].iloc[0]), int(rows["max_repeats"].iloc[0])
        counts = {int(n): int(c) for n, c in zip(rows["tokens"], rows["rows"])}
        total = sum(n * c for n, c in counts.items())
        passes = min(repeats, budget // total) if total else 0
        part, proved = best_subset({n: c for n, c in counts.items() if n}, budget - passes * total, seed, states) if passes < repeats and budget > passes * total else ({}, True)
        return pd.DataFrame({"mix_id": rows["mix_id"], "source": rows["source"], "tokens": rows["tokens"], "rows": rows["rows"], "passes": passes, "take": [part.get(int(n), 0) for n in rows["tokens"]], "ended": passes >= repeats or not total, "proved": proved})

    inputs = join_same(histogram, measured_side(asked.select("mix_id", "source", "budget", "max_repeats"), "budgets"), ["source"])
    shape = f"mix_id {asked.schema['mix_id'].dataType.simpleString()}, source string, tokens bigint, rows bigint, passes int, take bigint, ended boolean, proved boolean"
    plan = stage(inputs.groupBy("mix_id", "source").applyInPandas(planned, shape), "plan")

    salted = sizes.withColumns({"__h": F.xxhash64(F.lit(seed), "item"), "__one": F.lit(1)})
    copies = F.col("passes") + F.when(F.col("rank") < F.col("take"), 1).otherwise(0)
    uses = plan.filter("passes > 0 OR take > 0").select("mix_id", "source", "tokens", "passes", "take")
    ranked = lambda: running_sum(salted, ["source", "tokens"], ["__h", "item"], "__one", "rank", histogram, rows_per_bucket)
    chosen = lambda: join_same(ranked(), measured_side(uses, "uses"), ["source", "tokens"]).select("mix_id", F.col("item").alias(item), "source", "tokens", copies.alias("copies")).filter("copies > 0")

    reached = plan.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * (F.col("passes") * F.col("rows") + F.col("take"))).alias("reached"), F.bool_and("ended").alias("__ended"), F.bool_and("proved").alias("proved"))
    report = join_same(asked, reached, ["mix_id", "source"], "left").withColumns({"reached": F.coalesce("reached", F.lit(0)), "__ended": F.coalesce("__ended", F.lit(True)), "proved": F.coalesce("proved", F.lit(True))})
    report = stage(report, "report")
    totals = report.groupBy("mix_id").agg(F.sum("reached").alias("__all"))
    short = F.col("__ended") & (F.col("reached") < F.col("target_share") * F.col("mix_tokens"))
    shares = join_same(report, totals, ["mix_id"]).select("mix_id", F.col("given").alias("source"), "target_share", "max_repeats", "available", "mix_tokens", "budget", "reached", safe_ratio(F.col("reached"), F.col("__all")).alias("reached_share"), "proved", short.alias("falls_short"))
    return Mixture(chosen, shares)
