"""Fixed-capacity containers filled with items of varying length: a plan over the histogram of lengths, then an assignment by rank."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ordered import ROWS_PER_BUCKET, running_sum
from tidemark.plans.staging import stage

#: A slot: the items of one length whose rank is first .. first + n - 1 go, one each, to containers container .. container + n - 1, at one place within them.
SLOTS = T.StructType([T.StructField("tokens", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()), T.StructField("container", T.LongType()), T.StructField("place", T.IntegerType())])


def combinations(capacity: int, window: int, depth: int) -> np.ndarray:
    """All multisets of at most `depth` lengths from 1 to capacity with a sum above capacity - window and up to capacity, one per row, filled up with 0."""
    rows: list[tuple[int, ...]] = []

    def grow(taken: tuple[int, ...], left: int, most: int) -> None:
        if taken and left < window:
            rows.append(taken + (0,) * (depth - len(taken)))
        if len(taken) < depth:
            low = 1
            if len(taken) == depth - 1:
                low = max(1, left - window + 1)
            for x in range(min(most, left), low - 1, -1):
                grow((*taken, x), left - x, x)

    grow((), capacity, capacity)
    return np.array(sorted(set(rows)), dtype=np.int64).reshape(-1, depth)


def nonnegative_least_squares(combos: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, A[l, s] being how often combination s uses length l; accelerated projected gradient.

    A is never formed: a column has at most `depth` entries, so A x is a scatter and its transpose a gather.
    """
    size = len(target)
    used = combos > 0

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for j in range(combos.shape[1]):
            out += np.bincount(combos[:, j], weights=x * used[:, j], minlength=size)
        return out

    def backward(r: np.ndarray) -> np.ndarray:
        return np.where(used, r[combos], 0.0).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = backward(forward(v))
        v /= np.linalg.norm(v) or 1.0
    bound = np.linalg.norm(backward(forward(v))) * 1.05 or 1.0
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, y - backward(forward(y) - target) / bound)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan_containers(histogram: Mapping[int, int], capacity: int, bins: int = 256, window: int = 1, depth: int = 3) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots and the number of containers for items of the lengths of `histogram`, each from 1 to capacity.

    Lengths are rounded up to `bins` steps. Combinations of at most `depth` steps that fill the last `window`
    steps of a container are enumerated, and non-negative least squares gives how often each should be used for
    the histogram to come out. Counts are rounded and taken as far as items are there. What is left is packed
    greedily by exact length: the longest, then again and again the longest that still fits; a pattern found is
    repeated as often as its items allow. Work and memory depend on capacity, never on the number of items.
    """
    step = -(-capacity // bins)
    steps = capacity // step
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    lengths_of: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        lengths_of.setdefault(-(-n // step), []).append(n)
    given = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def take(n: int, count: int, at: int, place: int) -> None:
        slots.append((n, given[n], count, at, place))
        given[n] += count
        left[n] -= count

    free = np.zeros(steps + 2)
    for b, members in lengths_of.items():
        if b <= steps:
            free[b] = sum(left[n] for n in members)
    combos = combinations(steps, window, depth)
    combos = combos[((combos == 0) | (free[combos] > 0)).all(axis=1)]
    if len(combos):
        wanted = nonnegative_least_squares(combos, free)
        for s in np.argsort(-wanted, kind="stable"):
            if wanted[s] < 0.5:
                break
            parts = [int(b) for b in combos[s] if b]
            repeats = min([round(float(wanted[s])), *(int(free[b]) // parts.count(b) for b in set(parts))])
            if repeats < 1:
                continue
            for place, b in enumerate(parts):
                free[b] -= repeats
                at, need = containers, repeats
                while need:
                    n = lengths_of[b][-1]
                    if not left[n]:
                        lengths_of[b].pop()
                        continue
                    count = min(need, left[n])
                    take(n, count, at, place)
                    at, need = at + count, need - count
            containers += repeats

    rest = sorted(n for n, c in left.items() if c)
    while rest:
        room, pattern, used = capacity, [], {}
        high = len(rest)
        while high:
            n = rest[high - 1]
            fits = min(room // n, left[n] - used.get(n, 0))
            if fits:
                used[n] = used.get(n, 0) + fits
                pattern += [n] * fits
                room -= n * fits
            high = min(high - 1, bisect_right(rest, room))
        repeats = min(left[n] // k for n, k in used.items())
        for place, n in enumerate(pattern):
            take(n, repeats, containers, place)
        containers += repeats
        rest = [n for n in rest if left[n]]
    return slots, containers


def fill_containers(df: DataFrame, item: str, size: Column, capacity: int, rows_per_bucket: int = ROWS_PER_BUCKET, **plan: int) -> DataFrame:
    """Rows (`item`, part, start, tokens, container, place, is_split): the container of each item, or of each part of an item longer than one.

    An item over the capacity is cut into full containers of its own and one remaining part, which is packed like
    an item. Nothing else is divided. Containers are named ``c<number>``, full ones of a long item
    ``<item>/<part>``. Items of size 0 (empty or NULL) go to container ``c0``, whatever else it holds. An empty
    table gives no rows. Rows with equal ids are packed as items of their own.

    Only ids and sizes leave the scan; the driver sees the histogram of sizes up to the capacity, at most
    `capacity` numbers. Items are then ranked within their size, in buckets of `rows_per_bucket` where one size is
    frequent, and the rank decides slot and container; no container is gathered anywhere.
    """
    spark: SparkSession = df.sparkSession
    sizes = stage(df.select(F.col(item).alias("item"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size")), "sizes")
    last = F.col("size") % capacity
    packed = sizes.filter(last > 0).select("item", "size", last.cast("int").alias("tokens"))
    counted = packed.groupBy("tokens").agg(F.count(F.lit(1)).alias("rows"))
    histogram = {r["tokens"]: r["rows"] for r in counted.collect()}
    slots, _ = plan_containers(histogram, capacity, **plan)
    table = F.broadcast(spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], SLOTS).groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("first", "n", "container", "place"))).alias("slots")))
    ordered = packed.withColumns({"__h": F.xxhash64("item"), "__one": F.lit(1)})
    ranked = running_sum(ordered, ["tokens"], ["__h", "item"], "__one", "rank", max(histogram.values(), default=0), rows_per_bucket).drop("__h", "__one")
    slot = F.element_at(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["n"])), 1)
    part = F.floor(F.col("size") / capacity).cast("int")
    rest = ranked.join(table, "tokens").withColumn("slot", slot).select("item", part.alias("part"), (F.col("size") - F.col("tokens")).alias("start"), F.col("tokens").cast("bigint").alias("tokens"), F.concat(F.lit("c"), (F.col("slot.container") + F.col("rank") - F.col("slot.first")).cast("string")).alias("container"), F.col("slot.place").alias("place"), (F.col("size") > capacity).alias("is_split"))
    full = sizes.filter(F.col("size") >= capacity).select("item", F.explode(F.sequence(F.lit(0), part - 1)).alias("part"), "size").select("item", "part", (F.col("part").cast("bigint") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("tokens"), F.concat_ws("/", F.coalesce(F.col("item").cast("string"), F.lit("")), F.col("part").cast("string")).alias("container"), F.lit(0).alias("place"), (F.col("size") > capacity).alias("is_split"))
    none = sizes.filter("size = 0").select("item", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("tokens"), F.lit("c0").alias("container"), F.lit(0).alias("place"), F.lit(False).alias("is_split"))
    return rest.unionByName(full).unionByName(none).withColumnRenamed("item", item)
