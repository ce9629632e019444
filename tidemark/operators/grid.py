"""Grids and polygons as tables: points in polygons, zonal sums, resampling, nearest cells, overlap by union, cell areas, projections.

A polygon is a row (id, rings ARRAY<ARRAY<STRUCT<x, y>>>); a cell or point is a row (x, y, value). There is no
spatial index in Spark; polygons are cut along buckets of a coarse grid instead, points carry their bucket, and the
join is an equi-join on it that Catalyst can broadcast or sort, with the exact test on what is left.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import measured, safe_ratio
from tidemark.plans.staging import measured_side, stage

#: The ellipsoid GRS 80, the origin of the equal-area projection of Europe (3035), and the radius of Mollweide's sphere.
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257222101
LAEA_LAT, LAEA_LON, LAEA_X, LAEA_Y = 52.0, 10.0, 4_321_000.0, 3_210_000.0


def buckets(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size).cast("bigint"), F.floor(y / size).cast("bigint")


def polygon_edges(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """(key, bx, by, edges): for each bucket column by bucket row that a polygon's box meets, the edges that a ray from there to the right can cross.

    An edge is kept for a bucket if its y range meets the bucket's and it is not wholly to the left of it. So a
    polygon with many vertices is split over its buckets and no task holds more than one bucket's edges.
    """
    rings = polygons.select(key, F.posexplode("rings").alias("ring", "points"))
    closed = F.concat("points", F.slice("points", 1, 1))
    edges = rings.select(key, F.explode(F.zip_with(F.slice(closed, 1, F.size("points")), F.slice(closed, 2, F.size("points")), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))).alias("e"))
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    right = F.floor(F.greatest("e.x1", "e.x2") / size).cast("bigint")
    boxes = edges.groupBy(key).agg(F.floor(F.min(F.least("e.x1", "e.x2")) / size).cast("bigint").alias("__left"))
    rows = edges.where("e.y1 <> e.y2").withColumn("by", F.explode(F.sequence(F.floor(low / size).cast("bigint"), F.floor(high / size).cast("bigint"))))
    # every bucket to the left of the edge within the polygon's box can have its ray cross it
    cells = rows.join(boxes, key).withColumn("bx", F.explode(F.sequence(F.col("__left"), F.greatest(right, F.col("__left")))))
    return cells.groupBy(key, "bx", "by").agg(F.collect_list("e").alias("edges"))


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule with half-open edges, so holes count and a shared border belongs to one side."""
    crosses = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crosses) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, size: float, x: str = "x", y: str = "y", how: str = "inner") -> DataFrame:
    """`points` with the key of every polygon they lie in; with how="left", NULL for those in none."""
    edges = measured_side(polygon_edges(polygons, key, size), "edges")
    bx, by = buckets(F.col(x), F.col(y), size)
    joined = points.withColumns({"__bx": bx, "__by": by}).join(edges, (F.col("__bx") == F.col("bx")) & (F.col("__by") == F.col("by")) & inside(F.col("edges"), F.col(x), F.col(y)), how)
    return joined.drop("__bx", "__by", "bx", "by", "edges")


def first_polygon(points: DataFrame, polygons: DataFrame, point_key: str, key: str, size: float) -> DataFrame:
    """(point_key, key): of the polygons that a point lies in the least key, NULL for none; an aggregation, so nothing is ranked."""
    return points_in_polygons(points, polygons, key, size, how="left").groupBy(point_key).agg(F.min(key).alias(key))


def zonal(cells: DataFrame, polygons: DataFrame, key: str, size: float, value: str = "value") -> DataFrame:
    """Sum, count and mean of the measured cells whose centre lies in each polygon; a polygon without cells keeps NULL and 0, dry cells are 0."""
    v = measured(F.col(value).cast("double"))
    found = points_in_polygons(cells, polygons, key, size).groupBy(key).agg(F.sum(v).alias("zonal_sum"), F.count(v).alias("n_cells"), F.avg(v).alias("zonal_mean"))
    return polygons.select(key).join(found, key, "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))


def resample(cells: DataFrame, step: float, value: Column, keys: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Cells averaged (and their largest value, and count) onto a grid of `step`."""
    gx, gy = buckets(F.col(x), F.col(y), step)
    return cells.groupBy(*keys, gx.alias("gx"), gy.alias("gy")).agg(F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.count(value).alias("n_cells"))


def nearest_cell(left: DataFrame, right: DataFrame, step: float, value: str, x: str = "x", y: str = "y", required: bool = False) -> DataFrame:
    """`left` with the value of the cell of a regular grid (centres at multiples of `step`) nearest to it, at most half a step away. An equi-join on whole numbers.

    Where that cell isn't there the value is NULL, or the query fails if it is `required`: two grids that should be the same and aren't.
    """
    key = lambda c: F.floor(F.col(c) / step + 0.5).cast("bigint")
    grid = right.select(key(x).alias("__ix"), key(y).alias("__iy"), F.lit(True).alias("__there"), F.col(value))
    joined = left.withColumns({"__ix": key(x), "__iy": key(y)}).join(grid, ["__ix", "__iy"], "left")
    if required:
        far = F.concat(F.lit("no cell within half a step of "), F.col(x).cast("string"), F.lit(", "), F.col(y).cast("string"))
        joined = joined.withColumn(value, F.when(F.col("__there"), F.col(value)).otherwise(F.raise_error(far)))
    return joined.drop("__ix", "__iy", "__there")


def union_share(covers: DataFrame, cells: DataFrame, region: str, cell: str, area: str) -> DataFrame:
    """Share of each region's area under at least one cover: a cell counts once however many covers hold it, so overlaps never add up. Above 1 it raises."""
    under = covers.select(cell).distinct().withColumn("__in", F.lit(True))
    s = cells.join(under, cell, "left").groupBy(region).agg(F.sum(area).alias("area"), F.sum(F.when(F.col("__in"), F.col(area)).otherwise(0.0)).alias("covered"))
    share = safe_ratio(F.col("covered"), F.col("area"))
    checked = F.when(F.assert_true(F.coalesce(share, F.lit(0.0)) <= 1 + 1e-6).isNull(), F.least(share, F.lit(1.0)))
    return s.select(region, "area", "covered", checked.alias("share"))


def band_area_km2(low: Column, high: Column, width_deg: float) -> Column:
    """Area on the ellipsoid between two latitudes (degrees) and over `width_deg` of longitude."""
    e2 = FLATTENING * (2 - FLATTENING)
    e, b2 = math.sqrt(e2), (SEMI_MAJOR * (1 - FLATTENING)) ** 2

    def part(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return s / (2 * (1 - e2 * s * s)) + F.ln((1 + e * s) / (1 - e * s)) / (4 * e)

    return F.lit(math.radians(width_deg) * b2 / 1e6) * (part(high) - part(low))


def laea_europe(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to the metres of the equal-area projection of Europe."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)

    def q(s):
        log = math.log if isinstance(s, float) else F.ln
        return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    qp, s1 = q(1.0), math.sin(math.radians(LAEA_LAT))
    beta1, radius = math.asin(q(s1) / qp), SEMI_MAJOR * math.sqrt(qp / 2)
    d = SEMI_MAJOR * math.cos(math.radians(LAEA_LAT)) / math.sqrt(1 - e2 * s1 * s1) / (radius * math.cos(beta1))
    beta, turn = F.asin(q(F.sin(F.radians(lat))) / qp), F.radians(lon - LAEA_LON)
    b = radius * F.sqrt(2 / (1 + math.sin(beta1) * F.sin(beta) + math.cos(beta1) * F.cos(beta) * F.cos(turn)))
    x = LAEA_X + b * d * F.cos(beta) * F.sin(turn)
    y = LAEA_Y + b / d * (math.cos(beta1) * F.sin(beta) - math.sin(beta1) * F.cos(beta) * F.cos(turn))
    return x, y


def _rounds(start: Column, rounds: int, step) -> Column:
    """`step` applied so many times, as a fold, so that the expression doesn't grow with the rounds."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda x, _: step(x))


def _authalic() -> tuple[float, float]:
    """The eccentricity of the ellipsoid, and its authalic q at the pole."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    return e, (1 - e2) * (1 / (1 - e2) - math.log((1 - e) / (1 + e)) / (2 * e))


def laea_europe_inverse(x: Column, y: Column, rounds: int = 5) -> tuple[Column, Column]:
    """Metres of the equal-area projection of Europe to longitude and latitude in degrees; the latitude by a few rounds of Newton's method."""
    e, qp = _authalic()
    e2, s1 = e * e, math.sin(math.radians(LAEA_LAT))
    q1 = (1 - e2) * (s1 / (1 - e2 * s1 * s1) - math.log((1 - e * s1) / (1 + e * s1)) / (2 * e))
    beta1, radius = math.asin(q1 / qp), SEMI_MAJOR * math.sqrt(qp / 2)
    d = SEMI_MAJOR * math.cos(math.radians(LAEA_LAT)) / math.sqrt(1 - e2 * s1 * s1) / (radius * math.cos(beta1))
    u, v = (x - LAEA_X) / d, (y - LAEA_Y) * d
    rho = F.sqrt(u * u + v * v)
    angle = 2 * F.asin(rho / (2 * radius))
    beta = F.when(rho == 0, beta1).otherwise(F.asin(F.cos(angle) * math.sin(beta1) + v * F.sin(angle) * math.cos(beta1) / F.when(rho != 0, rho)))

    def newton(lat: Column) -> Column:
        s = F.sin(lat)
        w = 1 - e2 * s * s
        return lat + w * w / (2 * F.cos(lat)) * (qp * F.sin(beta) / (1 - e2) - s / w + F.ln((1 - e * s) / (1 + e * s)) / (2 * e))

    lat = _rounds(beta, rounds, newton)
    lon = LAEA_LON + F.degrees(F.atan2(u * F.sin(angle), rho * math.cos(beta1) * F.cos(angle) - v * math.sin(beta1) * F.sin(angle)))
    return F.when(rho == 0, LAEA_LON).otherwise(lon), F.degrees(lat)


def mollweide(lon: Column, lat: Column, rounds: int = 12) -> tuple[Column, Column]:
    """Degrees to metres of the Mollweide projection of the sphere with the ellipsoid's larger radius; its angle by Newton's method."""
    target = math.pi * F.sin(F.radians(lat))

    def newton(theta: Column) -> Column:
        slope = 2 + 2 * F.cos(2 * theta)
        return F.when(slope < 1e-12, theta).otherwise(theta - (2 * theta + F.sin(2 * theta) - target) / F.when(slope >= 1e-12, slope))

    theta = _rounds(F.radians(lat), rounds, newton)
    return SEMI_MAJOR * 2 * math.sqrt(2) / math.pi * F.radians(lon) * F.cos(theta), SEMI_MAJOR * math.sqrt(2) * F.sin(theta)


def mollweide_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres of the Mollweide projection to degrees; NULL longitude at the poles' single points of width 0."""
    theta = F.asin(y / (SEMI_MAJOR * math.sqrt(2)))
    lat = F.asin((2 * theta + F.sin(2 * theta)) / math.pi)
    lon = F.try_divide(math.pi * x, 2 * math.sqrt(2) * SEMI_MAJOR * F.cos(theta))
    return F.degrees(lon), F.degrees(lat)


def common_extent(layers: DataFrame, step: float) -> dict[str, float]:
    """The part that every layer covers, of rows (left, bottom, right, top) in one reference, widened to whole cells of `step`; ValueError if there is none.

    A cell that some layer doesn't cover was never looked at, and must not count as dry.
    """
    row = layers.agg(F.floor(F.max("left") / step).alias("left"), F.floor(F.max("bottom") / step).alias("bottom"), F.ceil(F.min("right") / step).alias("right"), F.ceil(F.min("top") / step).alias("top")).first().asDict()
    if None in row.values() or row["right"] <= row["left"] or row["top"] <= row["bottom"]:
        raise ValueError(f"the layers have no part in common: {row} in steps of {step}")
    return {k: int(v) * step for k, v in row.items()} | {"width": int(row["right"] - row["left"]), "height": int(row["top"] - row["bottom"])}


def clip_convex(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex window given anticlockwise: cut by one side of the window after the other."""
    out = subject
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def ring_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _edges(rings: list[list[tuple[float, float]]]) -> np.ndarray:
    """(x1, y1, x2, y2) of all sides but the level ones, lower end first."""
    sides = [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    e = np.array(sides, dtype=float).reshape(-1, 4)
    e = e[e[:, 1] != e[:, 3]]
    return np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)


def common_area(left: list[list[tuple[float, float]]], right: list[list[tuple[float, float]]]) -> float:
    """Area inside both of two polygons of any form, each by its rings and the even-odd rule, so holes and several parts count as they should.

    Between two neighbouring heights of vertices and crossings no sides cross, so the common width is linear in
    between, and height times width in the middle is exact.
    """
    a, b = _edges(left), _edges(right)
    if not len(a) or not len(b):
        return 0.0
    low, high = max(a[:, 1].min(), b[:, 1].min()), min(a[:, 3].max(), b[:, 3].max())
    if low >= high:
        return 0.0
    a, b = (e[(e[:, 3] > low) & (e[:, 1] < high)] for e in (a, b))
    every = np.concatenate([a, b])
    slope = (every[:, 2] - every[:, 0]) / (every[:, 3] - every[:, 1])
    at_zero = every[:, 0] - slope * every[:, 1]
    i, j = np.triu_indices(len(every), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (at_zero[j] - at_zero[i]) / (slope[i] - slope[j])
    real = np.isfinite(cross) & (cross > np.maximum(every[i, 1], every[j, 1])) & (cross < np.minimum(every[i, 3], every[j, 3]))
    heights = np.unique(np.concatenate([every[:, 1], every[:, 3], cross[real], [low, high]]))
    heights = heights[(heights >= low) & (heights <= high)]
    total = 0.0
    for y0, y1 in zip(heights[:-1], heights[1:]):
        y = (y0 + y1) / 2
        ends = []
        for sign, e in ((1, a), (2, b)):
            met = e[(e[:, 1] <= y) & (y < e[:, 3])]
            xs = met[:, 0] + (met[:, 2] - met[:, 0]) * (y - met[:, 1]) / (met[:, 3] - met[:, 1])
            ends += [(x, sign) for x in xs]
        state, since = 0, 0.0
        for x, sign in sorted(ends):
            if state == 3:
                total += (x - since) * (y1 - y0)
            state, since = state ^ sign, x
    return total


@F.pandas_udf(T.DoubleType())
def overlap_area(subject: pd.Series, window: pd.Series) -> pd.Series:
    """Area inside both of two polygons, each an array of rings of (x, y)."""
    rings = lambda polygon: [[(p["x"], p["y"]) for p in ring] for ring in polygon]
    return pd.Series([None if s is None or w is None else common_area(rings(s), rings(w)) for s, w in zip(subject, window)])


def overlay(left: DataFrame, right: DataFrame, left_key: str, right_key: str, size: float) -> DataFrame:
    """(left_key, right_key, area) of polygons of any form that overlap: pairs meet in a common bucket of their boxes, once, and their common area is taken in Arrow batches."""

    def boxed(df: DataFrame, key: str, out: str) -> DataFrame:
        points = F.flatten("rings")
        span = lambda axis: (F.array_min(F.transform(points, lambda q: q[axis])), F.array_max(F.transform(points, lambda q: q[axis])))
        (x0, x1), (y0, y1) = span("x"), span("y")
        steps = lambda a, b: F.sequence(F.floor(a / size).cast("bigint"), F.floor(b / size).cast("bigint"))
        base = df.select(key, F.col("rings").alias(out), x0.alias(f"{out}_x"), y0.alias(f"{out}_y"), x1.alias("__x1"), y1.alias("__y1")).where("__x1 IS NOT NULL")
        return base.withColumn("bx", F.explode(steps(F.col(f"{out}_x"), F.col("__x1")))).withColumn("by", F.explode(steps(F.col(f"{out}_y"), F.col("__y1")))).drop("__x1", "__y1")

    pairs = boxed(left, left_key, "l").join(boxed(right, right_key, "r"), ["bx", "by"])
    once = (F.col("bx") == F.floor(F.greatest("l_x", "r_x") / size)) & (F.col("by") == F.floor(F.greatest("l_y", "r_y") / size))
    return pairs.where(once).select(left_key, right_key, overlap_area("l", "r").alias("area")).where("area > 0")


def ring_depths(rings: list[list[tuple[float, float]]]) -> list[int]:
    """In how many other rings each ring lies: even ones are outlines, odd ones holes."""

    def within(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
        return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    middle = lambda ring: ((ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2)
    return [sum(within(middle(r), other) for k, other in enumerate(rings) if k != i) for i, r in enumerate(rings)]


def parts_of(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """The rings as polygons, each an outline followed by its holes; a hole belongs to the smallest outline of the depth above that holds it."""
    depth = ring_depths(rings)
    parts = {i: [rings[i]] for i, d in enumerate(depth) if d % 2 == 0}
    for i, d in enumerate(depth):
        if d % 2:
            holders = [k for k in parts if depth[k] == d - 1 and ring_depths([rings[i], rings[k]])[0]]
            parts[min(holders, key=lambda k: abs(ring_area(rings[k])))].append(rings[i])
    return list(parts.values())


def simplify(points: Sequence[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Points of a line without those nearer than `tolerance` to the line between the ones kept; with a stack, so that long rings don't recurse."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (x1, y1), (x2, y2) = points[a], points[b]
        length = math.hypot(x2 - x1, y2 - y1)
        far, at = tolerance, None
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else math.hypot(x - x1, y - y1)
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def contiguous_groups(touches: DataFrame, members: DataFrame, key: str, most_rounds: int = 40) -> DataFrame:
    """(key, group): connected parts of a graph of touching units, by least label with pointer jumping.

    Every round is one join and one aggregation written to the shared folder; rounds grow with the logarithm of the
    longest chain. RuntimeError if it hasn't settled after `most_rounds`.
    """
    both = touches.select(F.col("a"), F.col("b")).unionByName(touches.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stage(both, "touches")
    labels = stage(members.select(F.col(key).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        low = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("seen", "label")).alias("new"))
        jump = low.join(labels.select(F.col("node").alias("new"), F.col("label").alias("next")), "new", "left")
        moved = stage(jump.select("node", F.least("new", F.coalesce("next", "new")).alias("label"), F.col("label").alias("old")), "labels")
        if moved.where("label <> old").isEmpty():
            return moved.select(F.col("node").alias(key), F.col("label").alias("group"))
        labels = moved.drop("old")
    raise RuntimeError("components have not settled")


def levels_by_region(cells: DataFrame, polygons: DataFrame, key: str, size: float, level: str, limit: float, in_box: Column, least_share: float = 0.99, x: str = "x", y: str = "y") -> DataFrame:
    """Per region the highest level, the cells at `limit` or above, and the cells; all NULL where less than `least_share` of the region's cells lies in the box that was looked at."""
    inside_box = F.coalesce(in_box, F.lit(False))
    s = points_in_polygons(cells, polygons, key, size, x, y).groupBy(key).agg(F.max(F.when(inside_box, F.col(level))).alias("max_level"), F.count_if(inside_box & (F.col(level) >= limit)).alias("n_over"), F.count_if(inside_box).alias("n_cells"), F.avg(inside_box.cast("double")).alias("box_share"))
    seen = F.col("box_share") >= least_share
    return polygons.select(key).join(s, key, "left").select(key, "box_share", *(F.when(seen, F.col(c)).alias(c) for c in ("max_level", "n_over", "n_cells")))


def require_same_reference(a: DataFrame, b: DataFrame, srid: str = "srid") -> None:
    """ValueError unless both sides are in one and the same reference system."""
    there = [r[0] for r in a.select(srid).unionByName(b.select(srid)).distinct().limit(3).collect()]
    if len(there) != 1:
        raise ValueError(f"reference systems differ: {there}")
