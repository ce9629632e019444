"""Reference behaviour of the other operators on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import nan_to_null, safe_ratio
from tidemark.operators import agreement, checks, composite, ensemble, evidence, exposure, grid, hierarchy, series, shaping, star
from tidemark.operators.query_spec import SpecError, ask, compile_spec, parse_spec

EXPOSURE = [("BE31", 4e5, 4000.0, 10), ("BE32", 1.3e6, 26000.0, 10), ("NL33", 3.8e6, 380000.0, 10), ("DE11", 6e5, 1200.0, 10), ("BE31", 4e5, 8000.0, 100), ("BE32", 1.3e6, 52000.0, 100), ("NL33", 3.8e6, None, 100), ("DE11", 6e5, float("nan"), 100)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, k[:2], p, 0.8 if k == "NL33" else 1.0, e, rp) for k, p, e, rp in EXPOSURE], "nuts_id string, country string, total_pop double, hazard_coverage double, exposed_pop double, return_period int")


def spec(**more):
    return {"columns": ["exposed_pop"]} | more


def test_ask_defaults_to_the_rarest_and_counts_nulls(frame):
    r = ask(spec(filters=[{"column": "exposed_pop", "op": "!=", "value": 8000}]), frame, beside={"exposed_pop": "hazard_coverage"})
    assert r.rows.columns == ["nuts_id", "exposed_pop", "hazard_coverage"]
    assert [x.nuts_id for x in r.rows.collect()] == ["BE32"]
    assert tuple(r.counts.first()) == (1, 2) and r.scenario == 100 and r.defaulted


def test_ask_sorts_missing_last_both_ways(frame):
    for down in (True, False):
        got = [x.nuts_id for x in ask(spec(sort={"column": "exposed_pop", "descending": down}), frame).rows.collect()]
        assert set(got[2:]) == {"NL33", "DE11"}


@pytest.mark.parametrize("op,value,expected", [("==", 4000, 1), ("!=", 4000, 3), ("<", 4000, 1), ("<=", 4000, 2), (">", 4000, 2), (">=", 4000, 3), ("in", [4000, 1200], 2), ("not_in", [4000], 3), ("is_null", None, 0), ("not_null", None, 4)])
def test_operators(frame, op, value, expected):
    f = {"column": "exposed_pop", "op": op} | ({} if value is None else {"value": value})
    assert ask(spec(filters=[f], return_period=10), frame).counts.first().matched == expected


@pytest.mark.parametrize("bad", [[], {"columns": []}, spec(extra=1), spec(columns=["x"]), spec(limit=0), spec(limit=101), spec(limit=True), spec(filters=[{"column": "return_period", "op": "==", "value": 10}]), spec(filters=[{"column": "country", "op": "<", "value": "a"}]), spec(filters=[{"column": "exposed_pop", "op": "contains", "value": "a"}]), spec(filters=[{"column": "exposed_pop", "op": "==", "value": True}]), spec(filters=[{"column": "exposed_pop", "op": "in", "value": []}]), spec(filters=[{"column": "exposed_pop", "op": "is_null", "value": 1}]), spec(sort={"column": "exposed_pop", "descending": "no"})])
def test_refusals(frame, bad):
    with pytest.raises(SpecError):
        compile_spec(bad, frame)


def test_unknown_scenario_is_refused(frame):
    with pytest.raises(SpecError):
        ask(spec(return_period=7), frame)


def test_parse_spec():
    assert parse_spec('Sure: {"a": 1} ok') == {"a": 1}
    with pytest.raises(SpecError):
        parse_spec("no object")


def test_filter_reaches_the_scan(frame, tmp_path, spark):
    frame.write.parquet(str(tmp_path / "t"))
    plan = ask(spec(filters=[{"column": "total_pop", "op": ">", "value": 1e6}], return_period=10), spark.read.parquet(str(tmp_path / "t"))).rows._jdf.queryExecution().executedPlan().toString()
    assert "return_period" in plan.split("PushedFilters")[1] and "TakeOrderedAndProject" in plan


def test_expected_annual_exposure(spark):
    rows = [("a", 100.0, 0.1), ("a", 200.0, 0.01), ("b", 5.0, 0.1), ("c", None, 0.1), ("c", 1.0, 0.01)]
    got = {r.k: r for r in exposure.expected_annual_exposure(spark.createDataFrame(rows, "k string, exposed_pop double, annual_probability double"), ["k"]).collect()}
    assert got["a"].expected_annual_exposure == pytest.approx(13.5) and got["a"].frequent_tail_exposure == pytest.approx(45)
    assert (got["b"].status, got["c"].status, got["c"].expected_annual_exposure) == ("insufficient_return_periods", "missing_exposure", None)


def test_level_coverage_keeps_orphans(spark):
    parents = spark.createDataFrame([("P1", 10.0), ("P2", 0.0), ("P3", 4.0)], "code string, v double")
    children = spark.createDataFrame([("P1", 4.0), ("P1", 5.0), ("P2", 1.0), ("P9", 3.0)], "parent string, v double")
    got = {r.code: r for r in hierarchy.level_coverage(parents, children, "code", "parent", "v").collect()}
    assert got["P1"].coverage_ratio == pytest.approx(0.9) and got["P2"].coverage_ratio is None
    assert (got["P3"].child_total, got["P3"].n_children) == (0.0, 0) and (got["P9"].parent_total, got["P9"].coverage_ratio) == (None, None)


def test_guards(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError):
        hierarchy.require_unique(df, ["k"])
    with pytest.raises(hierarchy.EmptySelection):
        hierarchy.require_rows(df.where("v > 5"), "nothing")
    with pytest.raises(ValueError):
        hierarchy.require_columns(df, ["x"])


def test_own_else_parent_is_by_row(spark):
    own = spark.createDataFrame([("r1", "p", 1.0, None), ("r2", "p", None, None), ("r3", "q", None, None)], "r string, p string, a double, b double")
    up = spark.createDataFrame([("p", 7.0, 8.0)], "p string, a double, b double")
    got = {r.r: (r.a, r.b, r.level) for r in hierarchy.own_else_parent(own, up, "p", ["a", "b"]).collect()}
    assert got == {"r1": (1.0, None, "own"), "r2": (7.0, 8.0, "parent"), "r3": (None, None, None)}


def test_latest_period_skips_a_partial_year(spark):
    df = spark.createDataFrame([(y, f"r{i}") for y, n in ((2021, 10), (2022, 10), (2023, 4)) for i in range(n)], "y int, r string")
    assert hierarchy.latest_full_period(df, "y", "r").first().y == 2022


def test_composite_index(spark):
    df = spark.createDataFrame([("a", 0.0, 0.1, 3.0), ("b", 500.0, 0.2, 3.0), ("c", 1000.0, None, 3.0)], "k string, x double, y double, z double")
    got = {r.k: r for r in composite.composite_index(df, {"x": 1, "y": 1}).collect()}
    assert [got[k].vulnerability for k in "abc"] == [0.0, pytest.approx(0.75), 1.0] and got["c"].indicator_coverage == 0.5
    assert composite.composite_index(df, {"z": 1}).select(F.max("vulnerability")).first()[0] == 0.0
    for bad in ({"q": 1}, {"x": -1}, {"x": 0}):
        with pytest.raises(ValueError):
            composite.composite_index(df, bad)


def stability(rows, weights, draws, top, perturbation=0.3, seed=0):
    """Brute force: rank all units in every draw."""
    names = list(weights)
    low = {n: min(r[n] for r in rows.values() if r[n] is not None) for n in names}
    high = {n: max(r[n] for r in rows.values() if r[n] is not None) for n in names}
    scale = lambda n, v: None if v is None else 0.0 if high[n] == low[n] else min(max((v - low[n]) / (high[n] - low[n]), 0.0), 1.0)
    hits = dict.fromkeys(rows, 0)
    for w in composite.draw_weights(weights, perturbation, draws, seed):
        score = {}
        for k, r in rows.items():
            have = [(scale(n, r[n]), x) for n, x in zip(names, w) if r[n] is not None]
            if have:
                score[k] = sum(s * x for s, x in have) / sum(x for _, x in have)
        for k, s in score.items():
            hits[k] += sum(t >= s for t in score.values()) <= top
    return {k: h / draws for k, h in hits.items()}


def test_rank_stability(spark):
    import random

    r = random.Random(5)
    rows = {f"u{i}": {"x": r.choice([r.random(), 0.5, None]), "y": r.choice([r.random(), 0.5]), "z": r.random()} for i in range(60)} | {"none": {"x": None, "y": None, "z": None}}
    df = spark.createDataFrame([(k, v["x"], v["y"], v["z"]) for k, v in rows.items()], "k string, x double, y double, z double").repartition(5)
    weights = {"x": 1.0, "y": 2.0, "z": 0.5}
    got = {g.k: g for g in composite.rank_stability(df, "k", weights, draws=40, top=7).collect()}
    want = stability(rows, weights, 40, 7)
    assert {k: g.top_n_frequency for k, g in got.items()} == pytest.approx(want)
    assert got["none"].confidence == "not_measured"
    few = composite.rank_stability(df.limit(3), "k", {"z": 1.0}, draws=5, top=7).collect()
    assert {g.confidence for g in few} <= {"single_indicator", "not_measured"}


def test_pessimistic_rank(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,), (7.0,), (None,)], "v double")
    assert sorted((r.v or 0, r.rank) for r in df.select("v", composite.pessimistic_rank(F.col("v"), [F.lit(0)]).alias("rank")).collect() if r.rank) == [(5.0, 4)] * 3 + [(7.0, 1)]


def test_ensemble_single_member_never_agrees(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 1.0), ("c", -1.0), ("d", 1e400), ("d", None)], "k string, v double")
    got = {r.k: r for r in ensemble.ensemble(df, ["k"], "v").collect()}
    assert [got[k].ensemble_agrees_on_sign for k in "abcd"] == [False, True, False, False] and got["d"].ensemble_members == 0
    assert {r.k: r.models_agree for r in ensemble.models_agree(df, ["k"], "v").collect()} == {"a": True, "b": True, "c": False, "d": None}


def test_trend_uses_real_years(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in ((1991, 0.0), (1992, 1.0), (2000, 9.0), (2001, 10.0))] + [("b", 2000, 1.0)], "c string, year int, v double")
    got = {r.c: r for r in series.trends(df, ["c"], "year", "v").collect()}
    assert got["a"].sen_slope == 1.0 and got["a"].mk_s == 6 and got["b"].sen_slope is None and got["b"].mk_z is None


def test_known_trend_is_found(spark):
    import numpy as np

    noise = np.random.default_rng(0).normal(size=30)
    df = spark.createDataFrame([("a", 1991 + i, float(100 + 2 * i + noise[i])) for i in range(30)] + [("b", 1991 + i, float(noise[i])) for i in range(30)], "c string, year int, v double")
    got = {r.c: r for r in series.trends(df, ["c"], "year", "v").collect()}
    assert abs(got["a"].sen_slope - 2) < 0.15 and got["a"].mk_z > 1.96 > abs(got["b"].mk_z)


def test_confusion_hides_thin_evidence(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("u"), (F.col("id") % 3 == 0).alias("m"), (F.col("id") > 1).alias("o"))
    got = agreement.headline(agreement.confusion(df, ["u"], F.col("m"), F.col("o"))).collect()
    assert all(r.hit_rate is None and "not defined" in r.headline for r in got)


def test_zonal_zero_is_not_missing(spark):
    cells = spark.createDataFrame([(x + 0.5, y + 0.5, 10.0 if x < 2 else 0.0) for x in range(4) for y in range(4)], "x double, y double, value double")
    square = lambda k, x, y, w, h: (k, [[{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + h}, {"x": x, "y": y + h}]])
    regions = spark.createDataFrame([square("left", 0.0, 0.0, 2.0, 4.0), square("right", 2.0, 0.0, 2.0, 4.0), square("far", 50.0, 50.0, 1.0, 1.0)], "k string, rings array<array<struct<x: double, y: double>>>")
    for size in (0.7, 3.0, 100.0):
        got = {r.k: (r.zonal_sum, r.n_cells) for r in grid.zonal(cells, regions, "k", size).collect()}
        assert got == {"left": (80.0, 8), "right": (0.0, 8), "far": (None, 0)}


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 13).cast("double").alias("e"), F.lit(10.0).alias("p"), ((F.col("id") % 5) / 5).alias("c"))
    one = lambda n: sorted(map(tuple, exposure.extrapolated(df.repartition(n), ["k"], "e", "p", "c").collect()))
    for n in (7, 13):
        for a, b in zip(one(1), one(n)):
            assert a == pytest.approx(b, rel=1e-9)


def test_projection_and_areas(spark):
    x, y = grid.laea_europe(F.lit(5.0), F.lit(50.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), grid.band_area_km2(F.lit(-90.0), F.lit(90.0), 360.0).alias("earth")).first()
    assert (row.x, row.y) == (pytest.approx(3_962_799.45, abs=0.1), pytest.approx(2_999_718.85, abs=0.1))
    assert row.earth == pytest.approx(510_065_621.7, rel=1e-6)


def test_clip_simplify_and_groups(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert grid.ring_area(grid.clip_convex([(1.0, 1.0), (5.0, 1.0), (5.0, 5.0), (1.0, 5.0)], square)) == pytest.approx(1.0)
    assert grid.clip_convex([(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)], square) == []
    assert grid.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5)], 0.1) == [(0, 0), (2, 0), (3, 5)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 31), 50, 51, 99]], "n int")
    assert {r.n: r.group for r in grid.contiguous_groups(edges, nodes, "n").collect()} == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50, 99: 99}


def test_union_counts_a_cell_once(spark):
    cells = spark.createDataFrame([("c1", "r", 2.0), ("c2", "r", 2.0)], "cell string, region string, area double")
    covers = spark.createDataFrame([("c1",), ("c1",)], "cell string")
    assert grid.union_share(covers, cells, "region", "cell", "area").first().share == 0.5


def test_text(spark):
    df = spark.createDataFrame([("La santé des réseaux, [S2] 1 234,5 and [S9] in 2021",)], "t string")
    r = df.select(evidence.tokens(F.col("t")).alias("w"), evidence.invalid_citations(F.col("t"), F.lit(5)).alias("bad"), evidence.figures(F.col("t")).alias("n")).first()
    assert r.w == ["santé", "réseaux", "234", "2021"] and r.bad == [9] and r.n == ["12345", "2021"]
    assert evidence.html_text("<p>a &amp; b<script>x<y</script> c</p>") == "a & b c" and evidence.html_text(None) is None


def test_passages_pack_whole_sentences(spark):
    import re

    text = " ".join(f"Sentence number {i} {'x' * (i * 7 % 90)}." for i in range(40)) + " " + "y" * 950 + ". End."
    want, buffer = [], ""
    for s in re.split(r"(?<=[.!?])\s+", " ".join(text.split())):
        if buffer and len(buffer) + len(s) > 900:
            want.append(buffer.strip())
            buffer = ""
        buffer += s + " "
    want.append(buffer.strip())
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "source string, text string")
    got = evidence.passages(df, "source", "text").orderBy("source", "ordinal").collect()
    assert [r.text for r in got] == want and {r.source for r in got} == {"a"}


def test_bm25_refuses_when_silent(spark):
    docs = spark.createDataFrame([(1, "flood maps of rivers"), (2, "rivers and levees levees"), (3, None)], "id int, text string")
    asked = spark.createDataFrame([(1, "levees"), (2, "unicorn"), (3, None)], "q int, question string")
    hits = evidence.bm25(docs, "id", "text", asked, "q", "question").collect()
    assert [(h.q, h.id) for h in hits] == [(1, 2)]
    tf, mean = 2, 6 / 3
    assert hits[0].score == pytest.approx(math.log(1 + (3 - 1 + 0.5) / 1.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 3 / mean)), rel=1e-9)


def test_shapes(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 13)] + [(None,)], "v double")
    got = shaping.quantile_classes(df, "v", 3)
    assert sorted((r.v, r["class"]) for r in got.collect() if r.v) == [(float(i), (i - 1) // 4) for i in range(1, 13)]
    odd = spark.createDataFrame([("a,b", 1.5, True, None), ("12", 2.0, False, 0.12345)], "s string, x double, b boolean, y double")
    assert [r[0] for r in odd.select(shaping.toon_lines(odd)).collect()] == ['  "a,b",1.5,true,null', '  "12",2,false,0.1234']
    nested = spark.createDataFrame([((1, (2,)),)], "a struct<x: int, b: struct<y: int>>")
    assert shaping.flatten(nested).columns == ["a_x", "a_b_y"]
    with pytest.raises(ValueError):
        shaping.flatten(spark.createDataFrame([([1],)], "a array<int>"))


def test_star_and_checks(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("a", 100, 2.0), ("b", 10, 3.0)], "k string, rp int, v double")
    assert {r.k: r.v_selected for r in star.selected_scenario(df, "rp", ["k"], "v", 100).collect()} == {"a": 2.0, "b": 3.0}
    assert checks.missing_combinations(spark, {"k": ["a", "b"], "rp": [10, 100]}, df).collect()[0] == ("b", 100)
    states = checks.declared_against_present(spark.createDataFrame([("x",), ("y",)], "s string"), spark.createDataFrame([("y",), ("z",)], "s string"), "s")
    assert {r.s: r.state for r in states.collect()} == {"x": "missing", "y": "ok", "z": "undeclared"}
    assert checks.verdict(states, [], "state").first().verdict == "not ready"


def test_values(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0)], "a double, b double")
    assert [tuple(r) for r in nan_to_null(df).select("a", safe_ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [(1.0, None), (None, None)]


def test_defences_and_references(spark):
    df = spark.createDataFrame([("a", 100, 5.0, 100), ("a", 100, 7.0, 50), ("a", 100, 2.0, None), ("a", 100, None, 500)], "k string, rp int, exposed_pop double, standard int")
    r = exposure.residual(df, ["k"], "rp", "exposed_pop", "standard").first()
    assert (r.exposed_pop_all, r.exposed_pop_residual, r.n_held) == (14.0, 9.0, 2)
    a, b = spark.createDataFrame([(4326,)], "srid int"), spark.createDataFrame([(3035,)], "srid int")
    grid.require_same_reference(a, a)
    with pytest.raises(ValueError):
        grid.require_same_reference(a, b)


def test_key_names_like_internal_ones(spark):
    df = spark.createDataFrame([("a", 2000 + i, float(i)) for i in range(12)], "k string, year int, v double")
    for name in ("n", "q", "s", "up", "low", "any", "t", "key"):
        named = df.withColumnRenamed("k", name)
        assert ensemble.quartiles(named, [name], "v").first()[name] == "a"
        assert ensemble.ensemble(named, [name], "v").first()[name] == "a"
        assert ensemble.models_agree(named, [name], "v").first()[name] == "a"
        assert series.trends(named, [name], "year", "v").first()[name] == "a"
        assert star.selected_scenario(named, "year", [name], "v", 2003).first()[name] == "a"
