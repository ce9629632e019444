"""Joins onto regions, guards, selections, and the operators on polygons and projections, on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import agreement, composite, ensemble, evidence, exposure, grid, guards, hierarchy, layers, selection, shaping, star
from tidemark.sources import files, sinks
from tidemark.sources.tables import Loader
from tidemark.streaming import streams


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("a", 10), ("a", 100), ("b", 10), (None, 10)], "k string, rp int")


def test_layers_keep_every_row_once(spark, base):
    layer = spark.createDataFrame([("a", 1.0), ("z", 9.0), (None, 5.0), (None, 6.0)], "k string, v double")
    got = layers.onto(base, layer, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([("a", 10, 1.0), ("a", 100, 1.0), ("b", 10, None), (None, 10, None)], got.schema).collect()))
    with pytest.raises(ValueError, match="not unique"):
        layers.onto(base, layer.unionAll(layer), "k")
    with pytest.raises(ValueError, match="both"):
        layers.onto(base, layer.withColumnRenamed("v", "rp"), "k")
    with pytest.raises(ValueError):
        layers.assemble(base, [layer], "k")
    assert layers.onto(base.limit(0), layer.limit(0), "k").count() == 0


def test_reindex_star_and_parents(spark, base):
    values = spark.createDataFrame([("a", 1.0), ("q", 2.0)], "k string, v double")
    assert {r.k: r.v for r in layers.reindex(base.where("k IS NOT NULL"), values, "k").collect()} == {"a": 1.0, "b": None}
    parents = spark.createDataFrame([("a", 7.0)], "code string, up double")
    got = {r.k: (r.v, r.up) for r in layers.own_and_parent(base.where("k IS NOT NULL"), "k", F.substring("k", 1, 1), values, parents, "code").collect()}
    assert got == {"a": (1.0, 7.0), "b": (None, None)}
    with pytest.raises(ValueError, match="dimension"):
        layers.star(base, values, "k")
    assert layers.star(base.where("k = 'a'"), values, "k").count() == 2
    assert [r[0] for r in spark.createDataFrame([("a",), ("b",), (None,)], "c string").select(layers.group_of(F.col("c"), {"a": "x"})).collect()] == ["x", "district:b", None]


def test_shared_groups(spark):
    pieces = [("r1", "g1", "X", 90.0), ("r2", "g1", "Y", 80.0), ("r3", "g1", "Z", 1.0), ("r1", "g2", "X", 99.0), ("r4", "g3", "Y", 5.0), ("r1", "g4", "X", 95.0), ("r4", "g4", "Y", 60.0)]
    got = {r.region: r for r in layers.shared_groups(spark.createDataFrame(pieces, "region string, g string, c string, area double"), "region", "g", "c", "area", 50.0, {"g1": "Long"}).collect()}
    assert (got["r1"].shared_with, got["r1"].shared_names, got["r1"].countries_max) == (["Y"], ["g4", "Long"], 2)
    assert (got["r3"].shared_with, got["r4"].shared_names) == (["X", "Y"], ["g4"])


def test_guards_refuse(spark, base):
    one = spark.createDataFrame([("v", "a", "AA"), ("v", "b", "AA")], "variable string, member string, country string")
    assert guards.require_one_question(one, ["variable"], ["member"]) is one
    with pytest.raises(guards.Refused, match="disagree"):
        guards.require_one_question(one.withColumn("variable", F.col("member")), ["variable"], ["member"])
    with pytest.raises(guards.Refused, match="twice"):
        guards.require_one_question(one.unionAll(one), ["variable"], ["member"])
    with pytest.raises(guards.Refused, match="nothing"):
        guards.require_one_question(one.limit(0), ["variable"], ["member"])
    with pytest.raises(guards.Refused, match="one country"):
        guards.require_several_countries(one)
    with pytest.raises(guards.Refused, match="no country"):
        guards.require_several_countries(base)
    with pytest.raises(guards.Refused):
        guards.require_one_of("median", ("fraction", "count"), "mode")
    with pytest.raises(guards.Refused, match="grids"):
        guards.require_same_grid(base, "rp", ["k"])
    with pytest.raises(guards.Refused, match="claimed"):
        guards.require_one_owner(base, "k", "rp")
    cells = spark.createDataFrame([(0, 0), (1, 1)], "row int, col int")
    assert guards.require_same_shape(a=cells, b=cells) == (2, 2, 2)
    with pytest.raises(guards.Refused, match="different grids"):
        guards.require_same_shape(a=cells, b=cells.limit(1))
    nulls = guards.disagreements(spark.createDataFrame([("g", None), ("g", "x")], "g string, v string"), ["g"], ["v"]).first()
    assert (nulls.n_values, nulls.least, nulls.greatest) == (2, "NULL", "x")


def test_readings(spark):
    df = spark.createDataFrame([("+1.5C", "q50", "1971-01-01T00:00:00.000000000", "VIC-WUR", "12 ", 2021, 2, 30), ("gwl_2.0", "0.17", "1991_2020", "e_hype", "2O21", 2020, 2, 29), ("none", "x", "older", None, None, None, None, None)], "g string, q string, p string, m string, n string, y int, mo int, d int")
    rows = df.select(selection.warming_label(F.col("g")), selection.quantile_percent(F.col("q")), selection.period_label(F.col("p")), selection.token(F.col("m")), selection.to_number("n"), selection.date_of(F.col("y"), F.col("mo"), F.col("d")).cast("string")).collect()
    assert [tuple(r) for r in rows] == [("1p5", 50, "1971-2000", "vicwur", 12.0, None), ("2", 17, "1991-2020", "ehype", None, "2020-02-29"), (None, None, "older", None, None, None)]
    times = spark.createDataFrame([("2023-05-01T10:00:00", "2020"), (None, "2024-01-02"), ("", "2024-01-02"), ("soon", "2024-01-02")], "a string, b string")
    assert [r[0] for r in times.select(selection.year_of(F.col("a"), F.col("b"))).collect()] == [2023, 2024, 2024, None]
    wrong = selection.field_mismatches({"gcm": F.lit("MOHC-HadGEM2-ES"), "period": F.lit("2041-2070"), "rcm": F.lit(None).cast("string")}, {"period": "2071-2100"}, {"gcm": "hadgem2_es", "rcm": "x"})
    assert spark.range(1).select(wrong).first()[0] == ["period", "rcm"]
    with pytest.raises(ValueError):
        selection.upstream_km2(F.lit(1.0), F.lit(1.0), "acres")
    assert spark.range(1).select(selection.without_local_links(F.lit("[a](b.md) [c](https://x/d.md)")), selection.markdown_row(F.lit("a|b\nc"), F.lit(None))).first()[:] == ("a [c](https://x/d.md)", "| a\\|b c |  |")


def test_citations_must_be_known(spark):
    registry = spark.createDataFrame([("FD", "Floods Directive", "https://x", ["6", "7"])], "i string, short string, url string, articles array<string>")
    fine = spark.createDataFrame([("FD", "6"), ("FD", None)], "i string, a string")
    assert sorted(r.citation for r in selection.cited(fine, "i", "a", registry).collect()) == ["Floods Directive — https://x", "Floods Directive, Art. 6 — https://x"]
    for bad in (("FD", "9"), ("XX", None)):
        with pytest.raises(Exception, match="not in the registry"):
            selection.cited(spark.createDataFrame([bad], "i string, a string"), "i", "a", registry).collect()


def test_order_and_tail(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0), (4, 9.0)], "id int, v double")
    assert [r.id for r in selection.top(df, [selection.worst_first("v"), F.col("id")], 2).orderBy("place").collect()] == [1, 2]
    assert [r.id for r in selection.top(df, [selection.missing_last("v", True), F.col("id")], 9).orderBy("place").collect()] == [4, 2, 3, 1]
    tail = shaping.bottom_share(df.withColumn("g", F.lit("x")), ["g"], "v", "id", 0.5)
    assert {r.id: r.model_rank for r in tail.collect()} == {3: 3, 1: 4}
    with pytest.raises(ValueError):
        shaping.bottom_share(df.withColumn("g", F.lit("x")), ["g"], "v", "id", 0.5, most=1)
    assert {r.id: r.pessimistic_rank for r in composite.pessimistic_ranks(df, [], "v").collect()} == {1: None, 2: 3, 3: 3, 4: 1}


def test_runoff_and_reporting(spark):
    df = spark.createDataFrame([(True, True, True), (False, True, True), (False, True, False), (True, True, False), (True, False, False)], "m boolean, o boolean, r boolean").withColumn("u", F.lit(1))
    r = agreement.confusion(df, ["u"], F.col("m"), F.col("o"), least_observed=1, runoff=F.col("r"), domain=F.col("o")).first()
    assert (r.hits, r.misses_in_runoff, r.misses_outside_runoff, r.hit_rate_outside_runoff, r.outside_domain) == (2, 1, 1, 0.5, 1)
    regions = spark.createDataFrame([("a", "EL"), ("b", "XX")], "k string, c string")
    sites = spark.createDataFrame([("GR",)], "c string")
    areas = spark.createDataFrame([("b", 4.0, 1.0)], "k string, area double, wet double")
    assert {x.k: (x.area, x.share) for x in agreement.shares_where_reported(regions, areas, sites, "k", "c", "area", "wet").collect()} == {"a": (0.0, None), "b": (None, None)}


def test_stacked_filters_and_ratio(spark):
    one = spark.createDataFrame([("a", 1.0)], "k string, v double")
    got = exposure.stacked({100: one, 10: one})
    assert sorted((r.return_period, r.annual_probability) for r in got.collect()) == [(10, 0.1), (100, 0.01)]
    with pytest.raises(ValueError):
        exposure.stacked({})
    df = spark.createDataFrame([("a", 10, 1.0), ("a", 100, 2.0)], "k string, rp int, v double")
    for chosen, want in ((None, 2.0), ([10], 1.0), ([10, 100], None)):
        assert star.selected_scenario(df, "rp", ["k"], "v", 100, chosen).first().v_selected == want
    assert star.scenario_label([10, 100], 100) == "Pick one return period" and star.scenario_label(None, 100).startswith("1-in-100")
    assert hierarchy.ratio_to_total(one, spark.createDataFrame([(0.0,)], "total double"), "v").first().ratio is None


def test_tidy_long_finds_the_region_column(spark):
    df = spark.createDataFrame([("x y", "AB12", 1.0), ("z", "AB1", float("nan"))], "name string, code string, v double")
    assert [r.region_code for r in ensemble.tidy_long(df, "v").collect()] == ["AB12"]
    with pytest.raises(ValueError):
        ensemble.tidy_long(df.drop("code"), "v")
    side = ensemble.medians_side_by_side(spark.createDataFrame([("a", 1, 3.0), ("a", 1, 5.0), ("a", 2, None)], "k string, m int, v double"), "k", {"one": F.col("m") == 1, "two": F.col("m") == 2}, "v").first()
    assert (side.one, side.two) == (4.0, None)


def test_evidence_rows(spark):
    hits = spark.createDataFrame([(1, 7, 1, 2.34567)], "q int, doc int, rank int, score double")
    r = evidence.evidence_rows(hits, spark.createDataFrame([(7, "x" * 700)], "doc int, text string"), "q", "doc", "text").first()
    assert (r.id, r.doc) == ("S1", 7)
    assert (len(r.text), r.score) == (600, 2.346)


def area_by_points(left, right, n=400):
    """The common area of two polygons by counting the middles of small squares."""

    def inside(x, y, rings):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:] + r[:1])) % 2 == 1

    step = 10 / n
    return sum(inside((i + 0.5) * step, (j + 0.5) * step, left) and inside((i + 0.5) * step, (j + 0.5) * step, right) for i in range(n) for j in range(n)) * step * step


def test_common_area_of_any_polygons():
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    ell = [[(0.0, 0.0), (5.0, 0.0), (5.0, 2.0), (1.0, 2.0), (1.0, 4.0), (0.0, 4.0)]]
    holed = [*square, [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)]]
    parts = [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(6.0, 6.0), (9.0, 6.0), (9.0, 9.0), (6.0, 9.0)]]
    assert grid.common_area(square, ell) == pytest.approx(12) and grid.common_area(ell, square) == pytest.approx(12)
    assert grid.common_area(holed, parts) == pytest.approx(3 + 5) and grid.common_area(holed, square) == pytest.approx(64)
    assert grid.common_area(square, [[(20.0, 0.0), (21.0, 0.0), (21.0, 5.0)]]) == 0 and grid.common_area(square, []) == 0
    r = random.Random(3)
    for _ in range(3):
        a, b = ([[(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(6)]] for _ in range(2))
        assert grid.common_area(a, b) == pytest.approx(area_by_points(a, b, 150), abs=0.7)


def test_overlay_takes_all_rings(spark):
    shape = "k string, rings array<array<struct<x: double, y: double>>>"
    poly = lambda k, *rings: (k, [[{"x": x, "y": y} for x, y in ring] for ring in rings])
    outer, hole, far = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(30.0, 0.0), (31.0, 0.0), (31.0, 1.0), (30.0, 1.0)]
    left = spark.createDataFrame([poly("l", outer, hole, far)], shape)
    right = spark.createDataFrame([poly("r", [(0.0, 0.0), (40.0, 0.0), (40.0, 2.0), (0.0, 2.0)])], "q string, rings array<array<struct<x: double, y: double>>>")
    assert [(x.k, x.q, round(x.area, 9)) for x in grid.overlay(left, right, "k", "q", 7.0).collect()] == [("l", "r", 7.0)]
    out = json.loads(sinks.geojson_features(left, "k").first().feature)["geometry"]
    assert out["type"] == "MultiPolygon" and [len(p) for p in out["coordinates"]] == [2, 1]
    assert grid.overlay(left.limit(0), right, "k", "q", 7.0).count() == 0


def test_projections_go_back(spark):
    df = spark.createDataFrame([(5.0, 50.0), (-9.1, 38.7), (25.0, 60.2), (10.0, 52.0)], "lon double, lat double")
    x, y = grid.laea_europe(F.col("lon"), F.col("lat"))
    mx, my = grid.mollweide(F.col("lon"), F.col("lat"))
    there = df.select("lon", "lat", x.alias("x"), y.alias("y"), mx.alias("mx"), my.alias("my"))
    back = there.select("lon", "lat", *(c.alias(n) for c, n in zip((*grid.laea_europe_inverse(F.col("x"), F.col("y")), *grid.mollweide_inverse(F.col("mx"), F.col("my"))), ("a", "b", "c", "d")))).collect()
    for r in back:
        assert (r.a, r.b, r.c, r.d) == (pytest.approx(r.lon, abs=1e-8), pytest.approx(r.lat, abs=1e-8), pytest.approx(r.lon, abs=1e-8), pytest.approx(r.lat, abs=1e-8))


def test_nearest_cell_may_be_required(spark):
    p, cells = spark.createDataFrame([(0.4, 0.0), (9.0, 9.0)], "x double, y double"), spark.createDataFrame([(0.0, 0.0, 5)], "x double, y double, v int")
    assert {r.x: r.v for r in grid.nearest_cell(p, cells, 1.0, "v").collect()} == {0.4: 5, 9.0: None}
    with pytest.raises(Exception, match="half a step"):
        grid.nearest_cell(p, cells, 1.0, "v", required=True).collect()


def test_common_extent(spark):
    shape = "left double, bottom double, right double, top double"
    got = grid.common_extent(spark.createDataFrame([(0.0, 0.0, 100.0, 90.0), (15.0, 7.0, 200.0, 61.0)], shape), 20.0)
    assert got == {"left": 0.0, "bottom": 0.0, "right": 100.0, "top": 80.0, "width": 5, "height": 4}
    with pytest.raises(ValueError):
        grid.common_extent(spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (50.0, 50.0, 60.0, 60.0)], shape), 20.0)


def test_reference_is_declared(spark, tmp_path):
    ring = [[5, 50], [6, 50], [6, 51], [5, 50]]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    (tmp_path / "no.json").write_text(json.dumps(body))
    (tmp_path / "yes.json").write_text(json.dumps(body | {"crs": {"type": "name", "properties": {"name": "EPSG:4326"}}}))
    with pytest.raises(ValueError, match="reference"):
        files.reference_of(spark, str(tmp_path / "no.json"))
    assert files.reference_of(spark, str(tmp_path / "yes.json")) == "EPSG:4326"
    p = files.in_metres(files.geojson(spark, str(tmp_path / "yes.json"), {"id": "string"})).first().rings[0][0]
    assert (p.x, p.y) == (pytest.approx(3_962_799.45, abs=0.1), pytest.approx(2_999_718.85, abs=0.1))


def test_loader_sees_changes(spark, tmp_path):
    load, path = Loader(spark), str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        load.load(path)
    spark.range(3).withColumn("poverty_rate", F.lit(1)).write.parquet(path)
    first = load.load(path)
    assert first.count() == 3 and load.load(path) is first and "poverty_rate_pct" in first.columns
    spark.range(5).write.mode("overwrite").parquet(path)
    assert load.load(path).count() == 5


def test_replayed_stream_keeps_the_last_value(spark, tmp_path):
    made = spark.range(200).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("k"), F.lit(1.0).alias("v"))
    made.repartition(5).write.parquet(str(tmp_path / "e"))
    stream = streams.events(spark, str(tmp_path / "e"), made, files=1)
    got = streams.replayed(streams.tumbling(stream, "ts", "1 hour", ["k"], "v", late="1 day"), str(tmp_path / "out"), ["window_start", "k"])
    want = streams.tumbling(made, "ts", "1 hour", ["k"], "v")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
