"""One ranking from several differently scaled scores: percentiles, normal scores, weighted mean."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import measured, safe_ratio
from tidemark.plans.ordered import ROWS_PER_BUCKET, running_sum
from tidemark.plans.staging import join_same, measured_side, stage, stage_counted

#: Rows of a group that are compared pair by pair at once, and the difference of two means that counts as none.
ROWS_PER_BLOCK, NO_DIFFERENCE = 1_024, 1e-12
#: Wichura's rational approximation of the normal quantile (AS 241), numerators and denominators by region, lowest power first.
CENTRE = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727), (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
MIDDLE = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640), (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9))
TAIL = ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7), (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def _ratio(x: Column, both: tuple[Sequence[float], Sequence[float]]) -> Column:
    def poly(terms: Sequence[float]) -> Column:
        out = F.lit(terms[-1])
        for t in reversed(terms[:-1]):
            out = out * x + F.lit(t)
        return out

    return poly(both[0]) / poly(both[1])


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution function for p strictly between 0 and 1, to about 16 digits."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    outer = F.when(r <= 5.0, _ratio(r - 1.6, MIDDLE)).otherwise(_ratio(r - 5.0, TAIL))
    return F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, CENTRE)).otherwise(F.signum(q) * outer)


def count_below(df: DataFrame, group: Sequence[str], value: str, at: str | None = None, out: str = "below", ties: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`df` with `out`, the number of rows of the group whose `value` is less than this row's `at` (its own value if not given).

    Rows are first counted by value, so many equal values are one row; the running sum over values is cut into
    buckets in large groups; the counts then come back by an equi-join, which adaptive execution splits where a
    value is frequent. `ties`, if named, gets the number of rows with a value equal to `at`. Rows with NULL get NULL.
    """
    at = at or value
    events = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    if at != value:
        asked = df.filter(F.col(at).isNotNull()).select(*group, F.col(at).alias("__v")).distinct().withColumn("__n", F.lit(0).cast("bigint"))
        events = events.unionByName(asked).groupBy(*group, "__v").agg(F.sum("__n").alias("__n"))
    events, most = stage_counted(events, "value_counts")
    summed = running_sum(events, group, ["__v"], "__n", "__below", most, rows_per_bucket).withColumnRenamed("__v", "__at")
    joined = join_same(df.withColumn("__at", F.col(at)), summed, [*group, "__at"], "left")
    result = joined.withColumn(out, F.col("__below"))
    if ties:
        result = result.withColumn(ties, F.col("__n"))
    return result.drop("__at", "__n", "__below")


def _mean(z: Column, w: Column) -> Column:
    """Weighted mean of the scores that are there."""
    there = F.zip_with(z, w, lambda a, b: F.when(a.isNotNull(), b))
    return safe_ratio(F.aggregate(F.zip_with(z, w, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x), F.aggregate(there, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0))))


def rank_items(items: DataFrame, group: Sequence[str], item: str, scores: Sequence[str], weights: dict[str, float] | None = None, perturbation: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET, unique: bool = False) -> DataFrame:
    """One row (group, item, score, rank, parts) per item.

    Each score is replaced by its percentile within the group, equal values sharing the average rank:
    (number below + half the number equal) / number with a value. The inverse normal distribution maps that to a
    normal score, and the items are ordered by the weighted mean of theirs. So only the order within a score
    counts and no score decides by its range. All scores go through one pass: they are unpivoted, counted by value,
    and the normal score is worked out once per different value and joined back.

    A score that is NULL or NaN for an item is left out of the item's mean; an item without any has a NULL score and a
    NULL rank. A constant score gives every item the same and decides nothing. Equal means share the better
    rank. parts holds what rank_bounds and leading_group compare: the values and the normal scores in the order of
    `scores`, their weights, the share of column `perturbation` and the number of items with an equal mean. `items` has
    one row per group and item, repeats of it count once; NULL is a group of its own. `unique` promises a stored
    table without repeats, which is then not copied.
    """
    weight = F.array(*(F.lit(float((weights or {}).get(s, 1.0))) for s in scores))
    keep = [*group, item] + ([perturbation] if perturbation else [])
    items = items.select(*dict.fromkeys([*keep, *scores]))
    items = items if unique else stage(items.distinct(), "items")
    by = [*group, "__k"]
    long = items.select(*keep, F.posexplode(F.array(*(measured(F.col(s).cast("double")) for s in scores))).alias("__k", "__value"))
    counts, most = stage_counted(long.filter("__value IS NOT NULL").groupBy(*by, "__value").agg(F.count(F.lit(1)).alias("__n")), "value_counts")
    totals = measured_side(counts.groupBy(*by).agg(F.sum("__n").alias("__total")), "totals")
    placed = join_same(running_sum(counts, by, ["__value"], "__n", "__below", most, rows_per_bucket), totals, by)
    z = placed.select(*by, "__value", normal_quantile((F.col("__below") + F.col("__n") / 2) / F.col("__total")).alias("__z"))
    scored = join_same(long, z, [*by, "__value"], "left")
    pick = lambda c: F.array(*(F.max(F.when(F.col("__k") == k, F.col(c))) for k in range(len(scores))))
    wide = scored.groupBy(*keep).agg(pick("__value").alias("__values"), pick("__z").alias("__z"))
    wide = stage(wide.withColumn("score", _mean(F.col("__z"), weight)).withColumn("__minus", -F.col("score")), "scores")
    ranked = count_below(wide, group, "__minus", out="__above", ties="__ties", rows_per_bucket=rows_per_bucket)
    share = F.coalesce(F.col(perturbation).cast("double"), F.lit(0.0)) if perturbation else F.lit(0.0)
    parts = F.struct(F.col("__values").alias("values"), F.col("__z").alias("z"), weight.alias("w"), share.alias("share"), F.col("__ties").alias("ties"))
    return ranked.select(*group, item, "score", (F.col("__above") + 1).alias("rank"), parts.alias("parts"))


def score_range() -> tuple[Column, Column]:
    """The exact extremes of an item's mean when every weight may change by up to `parts.share`, under 1 and one for the group, either way.

    Of all ways to give the lowest i scores one factor and the others the other, one is the optimum.
    """
    share, pairs = F.col("parts.share"), F.arrays_zip(F.col("parts.z").alias("z"), F.col("parts.w").alias("w"))
    zs = F.array_sort(F.filter(pairs, lambda p: p["z"].isNotNull()))

    def extreme(first: Column, rest: Column, best) -> Column:
        total = lambda i, f: F.aggregate(F.transform(zs, lambda p, k: F.when(k < i, first).otherwise(rest) * f(p)), F.lit(0.0), lambda a, x: a + x)
        return best(F.transform(F.sequence(F.lit(0), F.size(zs)), lambda i: safe_ratio(total(i, lambda p: p["w"] * p["z"]), total(i, lambda p: p["w"]))))

    return extreme(1 + share, 1 - share, F.array_min), extreme(1 - share, 1 + share, F.array_max)


def difference_signs(x: np.ndarray, y: np.ndarray, weights: np.ndarray, share: float, open_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of rows of `x` and `y`, scores with NaN for none: can x's mean be above y's, can y's be above x's, under the same weights on both sides.

    Each weight may be from 1 - share to 1 + share of its own. Where both have the same scores, the difference is
    linear in the weights and its extremes are sums. Where they haven't, both means are ratios. Let w be a point
    where their difference is least and t the mean of x there. The weights that keep the mean of x at t or less are
    the box cut by one plane; a linear function decides how far y's mean comes on them, so a corner of that body
    does as well, and it has at most one weight strictly between its ends. So the edges of the box decide, and on
    an edge the sign of the difference is that of a quadratic function. Pairs outside `open_pairs` come out as
    False in both there.
    """
    x_above, y_above = (np.zeros((len(x), len(y)), dtype=bool) for _ in range(2))
    x_has, y_has = ~np.isnan(x), ~np.isnan(y)
    for mine in np.unique(x_has, axis=0):
        left = np.flatnonzero((x_has == mine).all(axis=1))
        for other in np.unique(y_has, axis=0):
            right = np.flatnonzero((y_has == other).all(axis=1))
            if (mine == other).all():
                centre, reach = (np.zeros((len(left), len(right))) for _ in range(2))
                for k in np.flatnonzero(mine):
                    d = weights[k] * (x[left, k][:, None] - y[right, k][None, :])
                    centre += d
                    reach += share * np.abs(d)
                x_above[np.ix_(left, right)] = centre + reach > NO_DIFFERENCE
                y_above[np.ix_(left, right)] = reach - centre > NO_DIFFERENCE
                continue
            i, j = np.nonzero(open_pairs[np.ix_(left, right)])
            i, j = left[i], right[j]
            either = np.flatnonzero(mine | other)
            up, down = np.zeros(len(i), dtype=bool), np.zeros(len(i), dtype=bool)
            zx, zy = np.where(x_has, x, 0.0), np.where(y_has, y, 0.0)
            for signs in itertools.product((1 - share, 1 + share), repeat=len(either)):
                v = np.zeros(len(weights))
                v[either] = weights[either] * signs
                d = (zx @ v / (v @ mine))[i] - (zy @ v / (v @ other))[j]
                up |= d > NO_DIFFERENCE
                down |= d < -NO_DIFFERENCE
            for k in np.flatnonzero(mine & other):
                rest = either[either != k]
                low, high = weights[k] * (1 - share), weights[k] * (1 + share)
                for signs in itertools.product((1 - share, 1 + share), repeat=len(rest)):
                    todo = np.flatnonzero(~(up & down))
                    if not len(todo):
                        break
                    v = np.zeros(len(weights))
                    v[rest] = weights[rest] * signs
                    a, b, c, d = (zx @ v)[i[todo]], v @ mine, (zy @ v)[j[todo]], v @ other
                    p, q = x[i[todo], k], y[j[todo], k]
                    # (a + p w) (d + w) - (c + q w) (b + w), highest or lowest where its slope is 0
                    square, line = p - q, a + p * d - c - q * b
                    with np.errstate(divide="ignore", invalid="ignore"):
                        at = -line / (2 * square)
                    inside = (at > low) & (at < high)
                    w = np.where(inside, at, low)
                    value = (a + p * w) / (b + w) - (c + q * w) / (d + w)
                    up[todo] |= inside & (value > NO_DIFFERENCE)
                    down[todo] |= inside & (value < -NO_DIFFERENCE)
            x_above[i, j], y_above[i, j] = up, down
    return x_above, y_above


def _settle(table: pa.Table) -> pa.Table:
    """(__id, __more_over, __more_under) of two blocks of a group, or of one with itself: of the pairs whose score ranges overlap, how many are always above the row and how many never."""
    block, first = table["__block"].to_numpy(), table["__first"][0].as_py()
    sides = [np.flatnonzero(block == first), np.flatnonzero(block == table["__second"][0].as_py())]
    z = table["__z"].combine_chunks()
    z = np.array(z.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(block), -1)
    low, high, ids = (table[c].to_numpy() for c in ("score_low", "score_high", "__id"))
    out = []
    (i, j), alone = sides, first == table["__second"][0].as_py()
    overlap = ~((low[i][:, None] > high[j][None, :]) | (high[i][:, None] < low[j][None, :]))
    i_above, j_above = difference_signs(z[i], z[j], np.array(table["__w"][0].as_py()), table["__share"][0].as_py(), overlap)
    out.append((ids[i], (overlap & j_above & ~i_above).sum(axis=1), (overlap & ~j_above).sum(axis=1) - alone))
    if not alone:
        out.append((ids[j], (overlap & i_above & ~j_above).sum(axis=0), (overlap & ~i_above).sum(axis=0)))
    return pa.table({n: pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k, n in enumerate(("__id", "__more_over", "__more_under"))})


def rank_bounds(ranked: DataFrame, group: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """`ranked`, from rank_items, with score_low, score_high (see score_range), rank_best, rank_worst and rank_holds in place of parts.

    rank_best is 1 + the number of items that are above this one for all allowed weights, rank_worst 1 + the
    number of those that are above it for some, with the same weights for both. No rank lies outside; the two need not be
    reached, since different items may need different weights. rank_holds, where they meet, is exact: were an item
    above only for some weights, the rank would change where it draws level, as means are continuous.

    Pairs with score ranges that don't overlap are only counted, by running sums. The others are compared: groups
    are cut by rank into blocks of about `rows_per_block` rows, and every two blocks whose ranges overlap are a task's
    unit of work. So the work grows with the square of a group's size, the memory of a task doesn't.
    """
    low, high = score_range()
    ranged = ranked.withColumns({"score_low": low, "score_high": high})
    base = stage(ranged.withColumns({"__low": -F.col("score_low"), "__high": -F.col("score_high"), "__id": F.monotonically_increasing_id()}), "ranked")
    total = base.groupBy(*group).agg(F.count("score").alias("__all"))
    salt = F.pmod("__id", F.ceil(F.col("parts.ties") / rows_per_block))
    block = F.floor((F.col("rank") - 1) / rows_per_block) * 2**24 + salt
    rows = base.filter("score IS NOT NULL").select(*group, "__id", "score_low", "score_high", F.col("parts.z").alias("__z"), F.col("parts.w").alias("__w"), F.col("parts.share").alias("__share"), block.alias("__block"))
    blocks = stage(rows.groupBy(*group, "__block").agg(F.min("score_low").alias("__from"), F.max("score_high").alias("__to")), "blocks")
    seconds = blocks.select(*group, F.col("__block").alias("__second"), F.col("__from").alias("__from_2"), F.col("__to").alias("__to_2"))
    met = join_same(blocks, seconds, group).filter("__block <= __second AND __from <= __to_2 AND __from_2 <= __to").select(*group, F.col("__block").alias("__first"), "__second", F.explode(F.array_distinct(F.array("__block", "__second"))).alias("__block"))
    paired = join_same(rows, met, [*group, "__block"])
    settled = paired.groupBy(*group, "__first", "__second").applyInArrow(_settle, "__id bigint, __more_over bigint, __more_under bigint")
    settled = settled.groupBy("__id").agg(F.sum("__more_over").alias("__more_over"), F.sum("__more_under").alias("__more_under"))
    above = count_below(base, group, "__low", "__high", "__over", rows_per_bucket=rows_per_bucket)
    under = count_below(above, group, "score_high", "score_low", "__under", rows_per_bucket=rows_per_bucket)
    joined = join_same(under, measured_side(total, "totals"), group).join(settled, "__id", "left")
    bounds = joined.withColumns({"rank_best": F.col("__over") + F.col("__more_over") + 1, "rank_worst": F.col("__all") - F.col("__under") - F.col("__more_under")})
    return bounds.withColumn("rank_holds", F.col("rank_best") == F.col("rank_worst")).drop("__low", "__high", "__id", "parts", "__over", "__under", "__all", "__more_over", "__more_under")


def _losses(mine: DataFrame, others: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """(group, __item, __top, __lost): how many of the `others` of its group each of `mine` is not above on more than half of the n values both have."""
    others = others.select(*group, F.col("__item").alias("__other"), F.col("__v").alias("__other_v"))
    wins, both = F.lit(0), F.lit(0)
    for i in range(n):
        x, y = F.get("__v", F.lit(i)), F.get("__other_v", F.lit(i))
        wins = wins + F.when(x > y, 1).otherwise(0)
        both = both + F.when(x.isNotNull() & y.isNotNull(), 1).otherwise(0)
    lost = ~F.col("__item").eqNullSafe(F.col("__other")) & (wins * 2 <= both)
    return join_same(mine, others, group).groupBy(*group, "__item", "__top").agg(F.count_if(lost).alias("__lost"))


def leading_group(items: DataFrame, ranked: DataFrame, group: Sequence[str], item: str, scores: Sequence[str], top: str, depth: int = 2) -> DataFrame:
    """(group, item) of the `top` items that each beat every other item on most of the scores both have.

    `top` is a column of `items`. Let a group of N have such a leading group of k: its members beat the N - k others,
    and no other item beats that many, since it loses to all k. So an item is a member if there are fewer than k others
    that it doesn't beat. If a group has no such set, all items of which that holds are found, up to 2k - 1 of them.

    The ranking proposes its first `depth` x top items, which are compared with all items of their group. Where k or
    more of them are members and beat all items but one another, nobody else can be one. In the other groups all items
    are compared with those proposed: who doesn't beat k of these is out. Whoever is left, wherever it ranks, is compared
    with all items. So the ranking decides only how many comparisons there are, not what is found. Item ids are unique
    in a group.
    """
    n, key = len(scores), [*group, "__item"]
    tops = stage(items.groupBy(*group).agg(F.max(top).alias("__top")).filter("__top > 0"), "groups")
    order = stage(join_same(ranked.select(*group, F.col(item).alias("__item"), F.col("rank").alias("__rank"), F.col("parts.values").alias("__v")), tops, group), "order")
    near = measured_side(order.filter(F.col("__rank") <= F.col("__top") * depth).drop("__rank"), "candidates")
    members = stage(join_same(_losses(near, order, group, n).filter("__lost < __top"), near.drop("__top"), key), "members")
    inside = _losses(members, members, group, n).groupBy(*group).agg(F.sum("__lost").alias("__inside"))
    counted = members.groupBy(*group, "__top").agg(F.count(F.lit(1)).alias("__found"), F.sum("__lost").alias("__lost"))
    settled = join_same(counted, inside, group).filter("__found >= __top AND __lost = __inside")
    open_groups = stage(join_same(tops, settled, group, "left_anti"), "open_groups")
    if open_groups.isEmpty():
        return members.select(*group, F.col("__item").alias(item))
    rows = stage(join_same(order, open_groups, group, "left_semi"), "open_rows")
    out = _losses(rows, near, group, n).filter("__lost >= __top")
    left = measured_side(join_same(rows, out, key, "left_anti"), "left")
    more = _losses(left, rows, group, n).filter("__lost < __top")
    found = join_same(members, open_groups, group, "left_anti").select(*key).unionByName(more.select(*key))
    return found.withColumnRenamed("__item", item)
