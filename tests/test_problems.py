"""Snapshots, profiles and filling on small cases worked out by hand or by brute force."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import distinct_rows, identifier
from tidemark.operators.fill import fill_missing
from tidemark.operators.profile import Rule, column_stats, drift, exact_quantiles, findings, profile, profile_of_counts, value_counts
from tidemark.operators.snapshots import snapshot_changes
from tidemark.plans.staging import stage
from tidemark.queries import problems
from tidemark.sources.tables import table

SNAP = "n int, id string, at timestamp, bytes bigint, sha string, key int, now int"
T0 = datetime(2024, 1, 1)


def changes(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SNAP)
    return {tuple(r) for r in snapshot_changes(df, "n", identifier("id"), [F.col("bytes"), F.lower("sha")], "at", "source_id").collect()}


def test_snapshot_kinds(spark):
    rows = [(1, "a", T0, 1, "X"), (1, "b", T0, 1, "x"), (1, "c", T0, None, None), (1, "d", T0, 5, "q"), (4, "A ", T0, 1, "x"), (4, "b", T0, 2, "x"), (4, "c", T0, None, None), (4, "e", T0, 1, "x"), (7, "a", T0, 1, "x"), (7, "b", T0, None, "x"), (7, "e", T0, 1, "x"), (7, "d", T0, 5, "q")]
    assert changes(spark, rows + rows[:3]) == {(4, "b", "changed"), (4, "d", "removed"), (4, "e", "added"), (7, "b", "changed"), (7, "c", "removed"), (7, "d", "added")}


def test_snapshot_latest_version_and_nulls(spark):
    rows = [(1, "a", T0, 1, "x"), (1, "a", T0 + timedelta(1), 2, "y"), (1, "a", None, 9, "z"), (2, "a", T0, 2, "Y"), (2, None, T0, 1, "x"), (None, "q", T0, 1, "x"), (3, None, T0, 1, "x")]
    assert changes(spark, rows) == {(2, None, "added"), (3, "a", "removed")}
    assert changes(spark, []) == set()
    assert changes(spark, rows[:1]) == set()


def test_null_and_value_swapped_is_a_change(spark):
    df = spark.createDataFrame([(1, "a", None, 7), (2, "a", 7, None)], "n int, id string, x int, y int")
    assert [r.change_kind for r in snapshot_changes(df, "n", F.col("id"), [F.col("x"), F.col("y")]).collect()] == ["changed"]


def test_one_shuffle_of_the_rows(spark):
    df = spark.createDataFrame([(1, "a", T0, 1, "x", 1, 1)], SNAP)
    plan = snapshot_changes(df, "n", F.col("id"), [F.col("bytes")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_distinct_rows_tell_nulls_apart(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (1, None, "a"), (1, None, "b")], "x int, y int, `odd name` string")
    assert distinct_rows(df, ["x"]).count() == 3


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_exact_quantiles(spark, limit):
    r = random.Random(3)
    data = [(load, r.choice([r.gauss(0, 100), float(r.randint(0, 5)), float("nan"), None])) for load in (1, 2) for _ in range(300 if load == 1 else 40)]
    df = spark.createDataFrame(data, "load int, v double")
    counts = stage(value_counts(df, "load", ["v"], repeats_once=False), "c")
    got = {q.load: q.quantiles for q in exact_quantiles(counts, "load", column_stats(counts, "load"), rows_per_bucket=limit).collect()}
    for load in (1, 2):
        seen = [v for n, v in data if n == load and v is not None and v == v]
        assert got[load] == pytest.approx(statistics.quantiles(seen, n=4, method="inclusive"))


def test_profile(spark):
    data = [(1, 5.0, 10.0, "AA1", 2**60, True), (1, 11.0, 10.0, "A", 2**60 + 1, None), (1, None, 10.0, None, None, False), (1, float("nan"), None, "AA1\n", 1, None)]
    df = spark.createDataFrame(data + data[:1], "load int, v double, top double, code string, big bigint, flag boolean")
    rules = {"v": Rule(low=0, high="top"), "code": Rule(pattern="[A-Z]{2}[0-9]")}
    p = {r.column_name: r for r in profile(df, "load", ["v", "code", "big", "flag"], rules).collect()}
    assert (p["v"].n_rows, p["v"].n_null, p["v"].n_nan, p["v"].n_distinct, p["v"].min_num, p["v"].max_num, p["v"].n_outside) == (4, 1, 1, 2, 5.0, 11.0, 1)
    assert (p["code"].n_pattern, p["code"].n_distinct, p["code"].quantiles) == (2, 3, None)
    assert (p["big"].n_distinct, p["big"].max_whole, p["flag"].n_distinct) == (3, 2**60 + 1, 2)


def test_profile_query_has_every_column(spark, data):
    got = {tuple(r) for r in problems.p3_profile(spark, data).select("table_name", "column_name").distinct().collect()}
    assert got == {(t, c) for t in ("exposure", "answers") for c in table(spark, data, t).columns if c != "load_no"}


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "load int, v double, n string")
    p = profile(empty, "load", ["v", "n"])
    assert p.count() == 0 and findings(p, "load").count() == 0


def test_findings(spark):
    loads = {1: [1.0, 2.0, 3.0, 4.0] * 3, 3: [1.0, 2.0, 3.0, 4.0] * 3, 4: [10.0, 20.0, 30.0, 40.0, None, None], 6: [float("nan"), None]}
    df = spark.createDataFrame([(n, i, v) for n, vs in loads.items() for i, v in enumerate(vs)], "load int, i int, v double")
    got = {tuple(r) for r in findings(profile(df, "load", ["v"], {"v": Rule(low=0, high=35)}), "load").collect()}
    assert got == {(4, "v", "range"), (4, "v", "nulls"), (4, "v", "shift"), (6, "v", "nulls"), (6, "v", "distinct")}


def test_null_step_is_exact(spark):
    data = [(1, i, None if i < 1 else 1.0) for i in range(10)] + [(2, i, None if i < 2 else 1.0) for i in range(10)] + [(3, i, None if i < 31 else 1.0) for i in range(100)]
    df = spark.createDataFrame(data, "load int, i int, v double")
    assert {(r.load, r.finding) for r in findings(profile(df, "load", ["v"]), "load").collect()} == {(3, "nulls")}


def test_drift(spark):
    data = [(1, i, "a" if i % 2 else "b", float(i)) for i in range(100)] + [(2, i, "a" if i % 2 else "b", float(i)) for i in range(100)] + [(5, i, "a" if i % 10 else "c", i * 3.0) for i in range(100)]
    df = spark.createDataFrame(data, "load int, i int, k string, v double")
    counts = stage(value_counts(df, "load", ["k", "v"]), "c")
    moved = {(r.load, r.column_name): r for r in drift(counts, "load", profile_of_counts(counts, "load", None, None)).collect()}
    assert set(moved) == {(2, "k"), (2, "v"), (5, "k"), (5, "v")}
    assert moved[2, "k"].psi == pytest.approx(0) and moved[2, "v"].chi_square == pytest.approx(0)
    assert moved[5, "k"].psi > 0.25 and moved[5, "v"].psi > 0.25


FILL = "record int, entity string, t bigint, v double, c string, extra string"


def filled(spark, rows, **more):
    df = spark.createDataFrame([(*r, "e") for r in rows], FILL)
    out = fill_missing(df, "record", "entity", "t", F.substring("entity", 1, 2), {"v": F.when(~F.isnan("v"), F.col("v"))}, {"c": F.col("c")}, **more)
    return {r.record: r for r in out.collect()}


def test_fill_methods(spark):
    rows = [(1, "aa1", 1, 10.0, "x"), (2, "aa1", 2, None, None), (3, "aa1", 4, 40.0, None), (4, "aa1", 20, None, None), (5, "aa2", 20, 7.0, "y"), (6, "bb1", 1, float("nan"), None), (7, "aa3", 20, 9.0, "y"), (8, None, 20, None, None), (9, "aa1", 7, None, None)]
    for limit in (1_000_000, 2):
        got = filled(spark, rows + rows[:2], rows_per_bucket=limit)
        assert len(got) == 9
        assert (got[2].v, got[2].v_method, got[2].v_distance) == (20.0, "interpolated", 1)
        assert (got[2].c, got[2].c_method, got[2].c_distance) == ("x", "carried", 1)
        assert (got[4].v, got[4].v_method, got[4].v_donors, got[4].c, got[4].c_method) == (8.0, "group", 2, "y", "group")
        assert (got[6].v, got[6].v_method, got[6].v_donors) == (None, "none", 0)
        assert (got[8].v_method, got[8].v_donors) == ("none", 0)
        assert (got[9].v, got[9].v_method, got[9].v_distance) == (40.0, "carried", 3)
        assert (got[1].v_method, got[5].v_method) == ("observed", "observed")


def test_interpolation_has_no_gap_limit(spark):
    rows = [(1, "aa1", 1, 10.0, "x"), (2, "aa1", 11, None, None), (3, "aa1", 21, 30.0, "z"), (4, "aa2", 11, 7.0, "y")]
    got = filled(spark, rows)[2]
    assert (got.v, got.v_method, got.v_distance, got.v_donors) == (20.0, "interpolated", 10, 1)
    assert (got.c, got.c_method) == ("y", "group")


def test_fill_nothing(spark):
    assert filled(spark, []) == {}
