import itertools
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.ranking import count_below, difference_signs, leading_group, normal_quantile, rank_bounds, rank_items

SCHEMA = "g string, item string, a double, b double, c double, rank int, below int, p double, top int"


def made(n, groups=("x", None), seed=0):
    r = random.Random(seed)
    pick = lambda s: r.choice([s * r.random() ** 8, s / 2, None])
    return [(g, f"i{i}", pick(1e6), pick(1.0), pick(3.0), 7, 8, 0.2, 3) for g in groups for i in range(n)]


def brute(rows):
    out = {}
    for g in {r[0] for r in rows}:
        inside = [r for r in rows if r[0] == g]
        for r in inside:
            zs = []
            for k in (2, 3, 4):
                have = [x[k] for x in inside if x[k] is not None]
                if r[k] is not None:
                    zs.append(NormalDist().inv_cdf((sum(x < r[k] for x in have) + sum(x == r[k] for x in have) / 2) / len(have)))
            out[g, r[1]] = (sum(zs) / len(zs) if zs else None, sorted(zs))
    return out


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-5, 0.02, 0.074, 0.076, 0.3, 0.5, 0.7, 0.925, 0.99999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-12)


@pytest.mark.parametrize("limit", [1_000_000, 9])
def test_ranking_against_brute_force(spark, limit):
    rows = made(60)
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    got = rank_bounds(rank_items(df, ["g"], "item", ["a", "b", "c"], perturbation="p", rows_per_bucket=limit), ["g"], limit).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        score, zs = want[r.g, r.item]
        assert r.score == (None if score is None else pytest.approx(score, abs=1e-9))
        if score is None:
            assert r["rank"] is None
            continue
        better = sum(s is not None and s > score + 1e-12 for (g, _), (s, _) in want.items() if g == r.g)
        assert r["rank"] == better + 1 and r.rank_best <= r["rank"] <= r.rank_worst
        means = [sum(w * z for w, z in zip(ws, zs)) / sum(ws) for ws in itertools.product((0.8, 1.2), repeat=len(zs))]
        assert (r.score_low, r.score_high) == (pytest.approx(min(means), abs=1e-9), pytest.approx(max(means), abs=1e-9))


def test_same_weights_on_both_sides():
    """The ranges of the means overlap, and yet the first is above for all weights."""
    weights, every = np.ones(2), np.ones((1, 1), dtype=bool)
    for share, other in ((0.05, False), (0.5, False), (0.95, True)):
        x, y = difference_signs(np.array([[2.0, 0.0]]), np.array([[1.9, -0.1 if share < 0.9 else 0.1]]), weights, share, every)
        assert (bool(x[0, 0]), bool(y[0, 0])) == (True, other)


def test_difference_signs_against_a_grid():
    r = np.random.default_rng(5)
    share, weights = 0.4, np.array([1.0, 2.0, 0.5])
    x, y = (np.where(r.random((60, 3)) < 0.25, np.nan, r.normal(size=(60, 3))) for _ in range(2))
    y[:30] = x[:30] + r.normal(size=(30, 3)) * 0.2
    x[np.isnan(x).all(axis=1)], y[np.isnan(y).all(axis=1)] = 0.1, 0.1
    up, down = difference_signs(x, y, weights, share, np.ones((60, 60), dtype=bool))
    grid = np.array(list(itertools.product(np.linspace(1 - share, 1 + share, 25), repeat=3))) * weights
    means = [np.nan_to_num(z) @ grid.T / ((~np.isnan(z)).astype(float) @ grid.T) for z in (x, y)]
    d = means[0][:, None, :] - means[1][None, :, :]
    assert not (~up & (d.max(axis=2) > 1e-9)).any() and not (~down & (d.min(axis=2) < -1e-9)).any()
    assert not (up & (d.max(axis=2) < -1e-3)).any() and not (down & (d.min(axis=2) > 1e-3)).any()


@pytest.mark.parametrize("block", [1_024, 7])
def test_held_ranks_against_brute_force(spark, block):
    """All pairs of complete items at all corners of the weights: the same items must be above at each."""
    r = random.Random(2)
    rows = [(g, f"i{i}", base + r.gauss(0, 1.5), base + r.gauss(0, 1.5), base + r.gauss(0, 1.5), 0, 0, 0.2, 1) for g in ("x", None) for i in range(40) for base in [i * 1.0]]
    rows += [("x", "twin", *rows[9][2:])]
    ranked = rank_items(spark.createDataFrame(rows, SCHEMA), ["g"], "item", ["a", "b", "c"], perturbation="p")
    got = rank_bounds(ranked, ["g"], rows_per_block=block).collect()
    by_range = holds = 0
    for g in ("x", None):
        inside = [x for x in rows if x[0] == g]
        z = {x[1]: [NormalDist().inv_cdf((sum(o[k] < x[k] for o in inside) + sum(o[k] == x[k] for o in inside) / 2) / len(inside)) for k in (2, 3, 4)] for x in inside}
        corners = [{i: sum(w * v for w, v in zip(ws, zs)) for i, zs in z.items()} for ws in itertools.product((0.8, 1.2), repeat=3)]
        mine = {x.item: x for x in got if x.g == g}
        assert len(mine) == len(inside)
        for i, x in mine.items():
            sets = [{o for o in z if c[o] > c[i] + 1e-11} for c in corners]
            assert (x.rank_best, x.rank_worst) == (1 + len(set.intersection(*sets)), 1 + len(set.union(*sets)))
            assert x.rank_holds == all(s == sets[0] for s in sets)
            holds += x.rank_holds
            by_range += 1 + sum(o.score_low > x.score_high for o in mine.values()) == len(mine) - sum(o.score_high < x.score_low for o in mine.values())
    assert holds > by_range


def test_range_does_not_decide(spark):
    rows = [("x", "wide", 1e9, 0.1, 0.1), ("x", "even", 10.0, 0.2, 0.2), ("x", "low", 1.0, 0.15, 0.05)]
    df = spark.createDataFrame([(*r, 0, 0, 0.0, 1) for r in rows], SCHEMA)
    assert rank_items(df, ["g"], "item", ["a", "b", "c"]).orderBy("rank").first()["item"] == "even"


def test_constant_and_missing_scores(spark):
    df = spark.createDataFrame([("x", str(i), 5.0, float(i), None, 0, 0, 0.0, 1) for i in range(4)], SCHEMA)
    got = {r.item: r["rank"] for r in rank_items(df, ["g"], "item", ["a", "b", "c"]).collect()}
    assert got == {"3": 1, "2": 2, "1": 3, "0": 4}
    empty = spark.createDataFrame([], SCHEMA)
    assert rank_items(empty, ["g"], "item", ["a"]).count() == 0


def test_count_below_at_another_value(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.randint(0, 9), r.choice([None, r.randint(-2, 12)])) for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, v int, w int")
    for limit in (1_000_000, 3):
        got = sorted(map(repr, ((x.g, x.v, x.w, x.below) for x in count_below(df, ["g"], "v", "w", rows_per_bucket=limit).collect())))
        assert got == sorted(repr((g, v, w, None if w is None else sum(h == g and u < w for h, u, _ in rows))) for g, v, w in rows)


def test_leading_group_against_all_pairs(spark):
    r = random.Random(9)
    rows = []
    for g, k, n in (("p", 3, 30), ("q", 1, 8), ("all", 9, 5), ("one", 1, 1)):
        for i in range(n):
            base = 100 if i < k else 0
            rows.append((g, f"{g}{i}", base + r.random(), (base + r.random()) if r.random() < 0.8 else None, r.random() * 1e6, 0, 0, 0.1, k))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(x) for x in leading_group(df, rank_items(df, ["g"], "item", ["a", "b", "c"]), ["g"], "item", ["a", "b", "c"], "top", depth=1).collect()}
    want = set()
    for x in rows:
        others = [y for y in rows if y[0] == x[0] and y[1] != x[1]]
        beats = lambda y: 2 * sum(x[k] is not None and y[k] is not None and x[k] > y[k] for k in (2, 3, 4)) > sum(x[k] is not None and y[k] is not None for k in (2, 3, 4))  # noqa: B023, E731
        if sum(map(beats, others)) >= len(others) + 1 - x[8]:
            want.add((x[0], x[1]))
    assert got == want


def test_leading_group_goes_down_the_ranking(spark):
    """The leader has one extreme low score and ranks behind, yet wins most comparisons."""
    rows = [("g", "lead", 10.0, 10.0, -99.0)] + [("g", f"i{i}", i / 10, i / 10, float(90 + i)) for i in range(40)]
    df = spark.createDataFrame([(*r, 0, 0, 0.1, 1) for r in rows], SCHEMA)
    ranked = rank_items(df, ["g"], "item", ["a", "b", "c"])
    assert ranked.where("item = 'lead'").first()["rank"] > 1
    assert [x.item for x in leading_group(df, ranked, ["g"], "item", ["a", "b", "c"], "top", depth=1).collect()] == ["lead"]


@pytest.mark.parametrize("depth", [1, 2])
def test_leading_group_without_a_leading_set(spark, depth):
    """Three items beat each other in a circle and all the rest, one of them far down the ranking; and groups without any order, values or both."""
    r = random.Random(3)
    rows = [("circle", *x, 0, 0, 0.1, 2) for x in [("a", 103.0, -1.0, 102.0), ("b", 102.0, 103.0, 101.0), ("c", 101.0, 102.0, 103.0)] + [(f"i{i}", i / 10, i / 10, i / 10) for i in range(40)]]
    rows += [(f"g{k}", f"i{i}", *(r.choice([r.randint(0, 5) * 1.0, r.random(), None]) for _ in range(3)), 0, 0, 0.1, k) for k in (0, 1, 4, 7, 14, 20) for i in range(15)]
    rows += [(g, f"i{i}", None, None, None, 0, 0, 0.1, k) for g, n, k in (("none", 9, 2), ("alone", 1, 1), (None, 3, 3), ("unasked", 3, None)) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    ranked = rank_items(df, ["g"], "item", ["a", "b", "c"])
    assert ranked.where("g = 'circle' AND item = 'a'").first()["rank"] > 4
    got = [tuple(x) for x in leading_group(df, ranked, ["g"], "item", ["a", "b", "c"], "top", depth).collect()]
    want = []
    for x in rows:
        others = [y for y in rows if y[0] == x[0] and y[1] != x[1]]
        beats = lambda y: 2 * sum(x[k] is not None and y[k] is not None and x[k] > y[k] for k in (2, 3, 4)) > sum(x[k] is not None and y[k] is not None for k in (2, 3, 4))  # noqa: B023, E731
        if x[8] is not None and sum(map(beats, others)) >= len(others) + 1 - x[8]:
            want.append((x[0], x[1]))
    assert {i for g, i in want if g == "circle"} == {"a", "b", "c"}
    assert sorted(got, key=repr) == sorted(want, key=repr)
