"""Results as files: partitions replaced one by one, columns of a layer replaced, CSV with lists as text, TopoJSON and GeoJSON, inline maps."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import nan_to_null
from tidemark.operators.grid import parts_of


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet by partition; only the partitions in `df` are replaced, each by the commit protocol, so a part built before stays."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_layer(base: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    """`base` with the columns of `layer` in place of its own of that name; ValueError if the layer knows keys that the base doesn't."""
    if not layer.select(key).join(base.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"the layer has values of {key} that the table hasn't")
    return base.drop(*(c for c in layer.columns if c != key)).join(layer, key, "left")


def as_text(field: T.StructField) -> Column:
    """Lists joined by "; ", all else as it is."""
    c = F.col(f"`{field.name}`")
    return F.array_join(c.cast("array<string>"), "; ").alias(field.name) if isinstance(field.dataType, T.ArrayType) else c


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*(as_text(f) for f in df.schema)).write.mode("overwrite").csv(path, header=True, quoteAll=False, emptyValue="")


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row in `value`, with every field, NaN and NULL as null."""
    clean = nan_to_null(df)
    return clean.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in clean.columns)), {"ignoreNullFields": "false"}).alias("value"))


def geojson_features(polygons: DataFrame, key: str, decimals: int = 4) -> DataFrame:
    """One GeoJSON feature per polygon, coordinates rounded and rings closed; several outlines make a MultiPolygon, each followed by its own holes."""
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(F.round(p["x"], decimals), F.round(p["y"], decimals)))
    parts = F.transform(polygon_parts("rings"), lambda part: F.transform(part, ring))
    feature = lambda kind, coordinates: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(key).alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))
    split = polygons.select(key, parts.alias("__parts"))
    return split.select(key, F.when(F.size("__parts") == 1, feature("Polygon", F.get("__parts", F.lit(0)))).otherwise(feature("MultiPolygon", F.col("__parts"))).alias("feature"))


_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(_POINT))))
def polygon_parts(rings: pd.Series) -> pd.Series:
    """Outlines with their holes, of the rings of a polygon with any number of parts."""
    points = lambda polygon: [[(p["x"], p["y"]) for p in r] for r in polygon]
    return rings.map(lambda polygon: None if polygon is None else [[[{"x": x, "y": y} for x, y in r] for r in part] for part in parts_of(points(polygon))])


def topojson_arcs(polygons: DataFrame, key: str) -> DataFrame:
    """(key, ring, arc, points): one arc per ring, numbered over all polygons in the order of their keys. A layer of regions for a map, so one task may number it."""
    rings = polygons.select(key, F.posexplode("rings").alias("ring", "points"))
    return rings.withColumn("arc", F.row_number().over(Window.orderBy(key, "ring")) - 1)


def topojson(polygons: DataFrame, key: str, name: str = "regions") -> str:
    """The whole document; as it is one text, the layer is collected."""
    arcs, geometries = [], {}
    for row in topojson_arcs(polygons, key).orderBy("arc").collect():
        points = [[p["x"], p["y"]] for p in row["points"]]
        arcs.append([*points, points[0]])
        geometries.setdefault(row[key], []).append([row["arc"]])
    shapes = [{"type": "Polygon", "arcs": a, "id": k, "properties": {key: k}} for k, a in geometries.items()]
    return json.dumps({"type": "Topology", "objects": {name: {"type": "GeometryCollection", "geometries": shapes}}, "arcs": arcs})


def map_svg(rows: Sequence[Mapping], colours: Sequence[str], width: int = 900, height: int = 620) -> str:
    """An inline map of collected regions (rings, class or None): missing values are hatched and never look like a class."""
    points = [(p["x"], p["y"]) for r in rows for ring in r["rings"] for p in ring]
    if not points:
        return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}"/>'
    x0, y1 = min(p[0] for p in points), max(p[1] for p in points)
    scale = min(width / (max(p[0] for p in points) - x0 or 1), height / (y1 - min(p[1] for p in points) or 1))
    shapes = []
    for r in rows:
        path = "".join("M" + "L".join(f"{(p['x'] - x0) * scale:.1f} {(y1 - p['y']) * scale:.1f}" for p in ring) + "Z" for ring in r["rings"])
        fill = "url(#missing)" if r["class"] is None else colours[r["class"]]
        shapes.append(f'<path fill-rule="evenodd" fill="{fill}" d="{path}"/>')
    hatch = '<defs><pattern id="missing" width="6" height="6" patternUnits="userSpaceOnUse"><path d="M0 6L6 0" stroke="#888"/></pattern></defs>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{hatch}{"".join(shapes)}</svg>'
