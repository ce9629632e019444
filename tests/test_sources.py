"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, jsonstat, sinks
from tidemark.streaming import streams


def test_jsonstat_holes(spark, tmp_path):
    cube = {"id": ["geo", "time"], "size": [3, 2], "value": {"2": 20.0, "5": 30.0}, "status": {"5": "p"}, "dimension": {"geo": {"category": {"index": {"C": 2, "A": 0, "B": 1}}}, "time": {"category": {"index": {"2020": 0, "2021": 1}}}}}
    (tmp_path / "c.json").write_text(json.dumps(cube))
    got = jsonstat.tidy(jsonstat.read_cubes(spark, str(tmp_path), ["geo", "time"]), ["geo", "time"], with_status=True).collect()
    assert sorted(map(tuple, got)) == [("B", "2020", 20.0, None), ("C", "2021", 30.0, "p")]


def test_geojson_round_trip(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    features = [{"type": "Feature", "properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"id": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]
    (tmp_path / "l.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    layer = files.geojson(spark, str(tmp_path / "l.json"), {"id": "string"})
    assert {r.id: [len(x) for x in r.rings] for r in layer.collect()} == {"a": [4], "b": [4, 4]}
    back = json.loads(sinks.geojson_features(layer.where("id = 'a'"), "id").first().feature)
    assert back["geometry"]["coordinates"][0] == [[float(x), float(y)] for x, y in ring]
    topo = json.loads(sinks.topojson(layer, "id"))
    assert len(topo["arcs"]) == 3 and [g["arcs"] for g in topo["objects"]["regions"]["geometries"]] == [[[0]], [[1], [2]]]
    svg = sinks.map_svg([{"rings": r.rings, "class": None if r.id == "b" else 0} for r in layer.collect()], ["#fff"])
    assert "url(#missing)" in svg and "#fff" in svg


def test_corpus_and_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.html").write_text("<p>page<script>no</script></p>")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    assert {r.source: r.text for r in files.corpus(spark, str(tmp_path)).collect()} == {"a.txt": "plain", "b.html": "page", "c.bin": ""}
    assert files.manifest(spark, str(tmp_path)).where("length(sha256) = 64").count() == 3
    assert files.discover(spark, str(tmp_path), r"^([a-z])\.(txt|html)$", ["stem", "form"]).count() == 2


def test_names_and_cells(spark):
    df = spark.createDataFrame([(1, 2)], "poverty_rate int, Latitude int")
    assert files.with_current_names(df).columns == ["poverty_rate_pct", "Latitude"]
    both = spark.createDataFrame([(1, 2)], "poverty_rate int, poverty_rate_pct int")
    assert files.with_current_names(both).columns == both.columns
    with pytest.raises(ValueError):
        files.by_alias(df)
    cells = files.cells_from_grid(spark.createDataFrame([(0, [1.0, -9999.0])], "row int, values array<double>"), "values", 0.0, 10.0, 2.0, -9999.0).collect()
    assert [(c.x, c.y, c.value) for c in cells] == [(1.0, 9.0, 1.0), (3.0, 9.0, None)]


def test_paged_source(spark):
    def fetch(offset, limit):
        return [(str(i),) for i in range(offset, min(offset + limit, 25))], offset + limit < 25

    spark.dataSource.register(files.PagedSource.reading(fetch, "value string", "pages25"))
    df = spark.read.format("pages25").option("total", 25).option("page_size", 10).load()
    assert df.count() == 25 and df.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="another page"):
        spark.read.format("pages25").option("total", 15).option("page_size", 10).load().count()


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_partitions(spark.createDataFrame([(1, 10), (2, 100)], "v int, rp int"), path, ["rp"])
    sinks.write_partitions(spark.createDataFrame([(3, 100)], "v int, rp int"), path, ["rp"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3]
    base = spark.createDataFrame([("a", 1, 2)], "k string, x int, y int")
    assert sinks.replace_layer(base, spark.createDataFrame([("a", 9)], "k string, y int"), "k").first() == ("a", 1, 9)
    with pytest.raises(ValueError):
        sinks.replace_layer(base, spark.createDataFrame([("b", 9)], "k string, y int"), "k")
    sinks.write_csv(spark.createDataFrame([(["a", "b"], 1)], "l array<string>, v int"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().l == "a; b"
    assert sinks.json_records(spark.createDataFrame([(float("nan"), None)], "a double, b string")).first().value == '{"a":null,"b":null}'


def test_streams_equal_batches(spark, tmp_path):
    made = spark.range(300).select(F.col("id"), (F.col("id") % 5).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 17).cast("double").alias("v"))
    path = str(tmp_path / "events")
    made.repartition(6).write.parquet(path)
    stream = streams.events(spark, path, made, files=2)
    got = streams.drain(streams.tumbling(stream, "ts", "1 hour", ["k"], "v"), "t1", "complete", str(tmp_path / "c1"))
    want = streams.tumbling(made, "ts", "1 hour", ["k"], "v")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    late = streams.drain(streams.tumbling(stream, "ts", "1 hour", ["k"], "v", late="10 hours"), "t2", "append", str(tmp_path / "c2"))
    assert late.exceptAll(want).count() == 0
    once = streams.drain(streams.once(stream.unionByName(stream), ["id"], "ts", "10 hours"), "t3", "append", str(tmp_path / "c3"))
    assert once.count() == 300
    peak = streams.drain(streams.running_extremes(stream, "k", "ts", "v"), "t4", "update", str(tmp_path / "c4"))
    assert {r.k: (r.n, r.highest) for r in peak.groupBy("k").agg(F.max("n").alias("n"), F.max("highest").alias("highest")).collect()} == {k: (60, 16.0) for k in range(5)}
    streams.write_parts(stream, str(tmp_path / "parts"), ["id"], str(tmp_path / "c5"), lambda b: b.where("id < 3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 3
    assert streams.sliding(made, "ts", "2 hours", "1 hour", ["k"]).agg(F.sum("n")).first()[0] == 600
    assert streams.look_back(made, "ts", 1, "2023-11-15 00:00:00").count() > 0
