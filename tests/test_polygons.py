"""Points in polygons against the even-odd rule over all sides, and the number of sides a point meets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import spatial as spa


def ring(n, x, y, r, wobble=0.0, seed=0):
    rnd = np.random.default_rng(seed)
    return [(x + r * (1 + wobble * rnd.uniform(-1, 1)) * math.cos(2 * math.pi * k / n), y + r * (1 + wobble * rnd.uniform(-1, 1)) * math.sin(2 * math.pi * k / n)) for k in range(n)]


SHAPES = [(1, 5, 0, ring(400, 0.0, 0.0, 100.0, 0.3, 1)), (1, 5, 1, ring(60, 10.0, 5.0, 20.0, 0.2, 2)), (2, 1, 0, ring(5, 90.0, 90.0, 3.0)), (3, 2, 0, [(-80.0, -80.0), (80.0, -80.0), (80.0, 80.0), (-80.0, 80.0)]),
          (4, 0, 0, [(150.0, 0.0), (150.0, 0.0), (150.0, 0.0)]), (6, 3, 0, ring(300, 60.0, -60.0, 0.01, 0.5, 3)), (7, 4, 0, [(0.0, 200.0), (50.0, 200.0), (50.0, 230.0), (20.0, 230.0), (20.0, 210.0), (10.0, 210.0), (10.0, 230.0), (0.0, 230.0)])]


def frame(spark, shapes):
    return spark.createDataFrame([(g, p, r, k, x, y) for g, p, r, pts in shapes for k, (x, y) in enumerate(pts)], "region int, priority int, ring int, seq int, x double, y double")


def brute(shapes, points):
    out = set()
    for g, p in {(g, p) for g, p, _, _ in shapes}:
        sides = [(a, b) for gg, _, _, pts in shapes if gg == g for a, b in zip(pts, pts[1:] + pts[:1])]
        a, b = np.array([s[0] for s in sides]), np.array([s[1] for s in sides])
        for i, (x, y) in points.items():
            over = (a[:, 1] > y) != (b[:, 1] > y)
            at = (b[over, 0] - a[over, 0]) * (y - a[over, 1]) / (b[over, 1] - a[over, 1]) + a[over, 0]
            if (x < at).sum() % 2:
                out.add((i, g, p))
    return out


@pytest.mark.parametrize("most", [4, 32])
def test_polygons_equal_the_even_odd_rule(spark, most):
    rnd = np.random.default_rng(8)
    places = [*rnd.uniform(-140, 240, (1500, 2)), *rnd.normal((60, -60), 0.01, (200, 2)), *[(float(x), float(y)) for x in range(-10, 60, 5) for y in range(195, 235, 5)]]
    points = {i: (float(x), float(y)) for i, (x, y) in enumerate(places)}
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in points.items()] + [(9001, None, 1.0), (9002, float("nan"), 0.0), (9003, float("inf"), 0.0)], "point_id long, x double, y double")
    got = {tuple(r) for r in spa.polygons_of_points(p, frame(spark, SHAPES), most).collect()}
    assert got == brute(SHAPES, points)
    assert spa.polygons_of_points(p, frame(spark, SHAPES).limit(0)).count() == 0


def test_a_point_meets_few_sides_of_a_long_outline(spark):
    n = 100_000
    k = F.col("id") * (2 * math.pi / n)
    radius = F.lit(1000.0) + 60 * F.sin(k * 37)
    rings = spark.range(n).select(F.lit(1).alias("region"), F.lit(0).alias("priority"), F.lit(0).alias("ring"), F.col("id").cast("int").alias("seq"), (radius * F.cos(k)).alias("x"), (radius * F.sin(k)).alias("y"))
    leaves, grid = spa.tile_cover(rings)
    sizes = leaves.agg(F.max(F.size("sides")).alias("most"), F.sum(F.size("sides")).alias("all"), F.count(F.when(F.size("sides") == 0, 1)).alias("inside")).first()
    assert sizes["most"] <= spa.SIDES and sizes["all"] < 2 * n and sizes["inside"] > 100
    rnd = np.random.default_rng(3)
    places = rnd.uniform(-1100, 1100, (3000, 2))
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "point_id long, x double, y double")
    got = {r["point_id"] for r in spa.polygons_of_points(p, rings).collect()}
    want = {i for i, (x, y) in enumerate(places) if math.hypot(x, y) < 1000 + 60 * math.sin(37 * math.atan2(y, x))}
    edge = {i for i, (x, y) in enumerate(places) if abs(math.hypot(x, y) - 1000 - 60 * math.sin(37 * math.atan2(y, x))) < 0.01}
    assert got - edge == want - edge
