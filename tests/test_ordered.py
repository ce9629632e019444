"""Running sums and carried values must not depend on whether a group is cut into buckets."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans.ordered import carried, count_up_to, numbered, quantiles, running_sum
from tidemark.plans.staging import NoSharedFolder, join_same, measured_side, shared_dir, stage


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(1)
    made = {(g, r.randint(-500, 500)): r.randint(0, 5) for g in ("a", "b", None) for _ in range(400 if g == "a" else 40)}
    return spark.createDataFrame([(g, v, n) for (g, v), n in made.items()], "g string, v int, n int"), made


@pytest.mark.parametrize("limit", [1_000_000, 37, 5])
def test_running_sum(values, limit):
    df, made = values
    got = {(r.g, r.v): r.below for r in running_sum(df, ["g"], ["v"], "n", rows_per_bucket=limit).collect()}
    assert got == {(g, v): sum(m for (h, w), m in made.items() if h == g and w < v) for g, v in made}


@pytest.mark.parametrize("limit", [1_000_000, 11])
def test_carried(spark, limit):
    r = random.Random(2)
    made = {("x", t): r.random() if r.random() < 0.3 else None for t in range(200)}
    df = spark.createDataFrame([(g, t, v) for (g, t), v in made.items()], "g string, t int, v double")
    for row in carried(df, ["g"], "t", ["v"], rows_per_bucket=limit).collect():
        before = [(t, v) for (_, t), v in made.items() if v is not None and t < row.t]
        after = [(t, v) for (_, t), v in made.items() if v is not None and t > row.t]
        assert (tuple(row.prev_v) if row.prev_v else None) == (max(before) if before else None)
        assert (tuple(row.next_v) if row.next_v else None) == (min(after) if after else None)


def test_one_group_without_a_key(spark):
    df = spark.range(50).select(F.col("id").alias("v"), F.lit(2).alias("n"))
    for limit in (1_000, 7):
        assert {r.v: r.below for r in running_sum(df, [], ["v"], "n", rows_per_bucket=limit).collect()} == {i: 2 * i for i in range(50)}


def test_empty(spark):
    empty = spark.createDataFrame([], "g string, v int, n int")
    assert running_sum(empty, ["g"], ["v"], "n").count() == 0


def test_broadcast_only_below_its_bound(spark):
    """By bytes, not rows: one long text is over a bound that many numbers keep to."""
    plan = lambda df, most: spark.range(10).join(measured_side(df, memory_bytes=most), "id")._jdf.queryExecution().optimizedPlan().toString()
    numbers, text = spark.range(1_000), spark.range(1).withColumn("t", F.lit("x" * 100_000))
    assert "strategy=broadcast" in plan(numbers, 50_000) and "strategy=broadcast" not in plan(text, 50_000)
    assert "strategy=broadcast" in plan(text, 200_000) and "strategy=broadcast" not in plan(numbers, 5_000)
    assert "strategy=broadcast" in plan(spark.range(0), 10)


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(NoSharedFolder):
        shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/x/"}
    assert shared_dir(Session()) == "hdfs://shared/x"
    Session.conf, Context.master = {}, "local[2]"
    assert shared_dir(Session()).startswith("file:")


@pytest.mark.parametrize("limit", [1_000_000, 13])
def test_quantiles_numbers_and_counts(spark, limit):
    import statistics

    r = random.Random(5)
    made = [(g, r.choice([None, r.gauss(0, 9), 1.0]), i) for i, g in enumerate(["a"] * 150 + ["b"] * 3 + [None] * 9)]
    df = spark.createDataFrame(made, "g string, v double, i int")
    got = {q.g: q.v for q in quantiles(df, ["g"], {"v": F.col("v"), "none": F.lit(None)}, [0.25, 0.5, 0.75], limit).collect()}
    for g in {g for g, v, _ in made if v is not None}:
        seen = [v for h, v, _ in made if h == g and v is not None]
        assert got[g] == pytest.approx(statistics.quantiles(seen, n=4, method="inclusive") if len(seen) > 1 else seen * 3)
    assert {x.i: x.number for x in numbered(df, ["g"], ["i"], rows_per_bucket=limit).collect()} == {i: 1 + sum(h == g and j < i for h, _, j in made) for g, _, i in made}
    upto = {x.i: x.c for x in count_up_to(df, ["g"], "v", "c", limit).collect()}
    assert upto == {i: None if v is None else sum(h == g and w is not None and w <= v for h, w, _ in made) for g, v, i in made}


def test_null_keys_meet(spark):
    a, b = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int"), spark.createDataFrame([(None, 3)], "k string, b int")
    assert [tuple(r) for r in join_same(a, b, ["k"]).collect()] == [(None, 1, 3)]
    assert join_same(a, b, ["k"], "left").count() == 2


def test_stage_keeps_rows(spark):
    assert stage(spark.range(5).withColumn("x", F.lit(None).cast("string")), "t").count() == 5
