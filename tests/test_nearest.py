"""Nearest cells against all pairs, for spreads that fixed buckets handle badly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators.nearest import Pyramid, candidates, nearest_cell

RNG = np.random.default_rng(21)
SPREADS = {
    "even": (RNG.uniform(0, 50, (300, 2)), RNG.uniform(-5, 55, (200, 2))),
    "clusters": (np.vstack([RNG.normal(c, 0.001, (150, 2)) for c in ((0, 0), (900, 5), (900, 900))]), np.vstack([RNG.normal((0, 0), 0.001, (80, 2)), RNG.uniform(-400, 1400, (80, 2))])),
    "ring": (np.array([(np.cos(a), np.sin(a)) for a in np.linspace(0, 6.28, 200)]) * 100, np.vstack([RNG.normal(0, 1, (50, 2)), [[0.0, 0.0], [1e6, -1e6]]])),
    "lattice": (np.array([(float(i), float(j)) for i in range(18) for j in range(18)]), np.array([(i + 0.5, j + 0.5) for i in range(-3, 20) for j in range(-3, 9)])),
    "one": (np.array([[3.0, 4.0]]), RNG.uniform(-1e5, 1e5, (20, 2))),
    "copies": (np.repeat([[1.0, 1.0], [2.0, 2.0]], 150, axis=0), np.array([[1.1, 1.0], [1.9, 2.5], [1.5, 1.5]])),
}


def brute(cells, points):
    out = {}
    for i, p in enumerate(points):
        d = np.sqrt(((cells - p) ** 2).sum(axis=1))
        out[i] = (int(np.flatnonzero(d == d.min())[0]), float(d.min()))
    return out


def frames(spark, cells, points):
    return (spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "point_id long, x double, y double"),
            spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(cells)], "cell_id long, x double, y double"))


@pytest.mark.parametrize("name", SPREADS)
def test_nearest_equals_brute_force(spark, name):
    cells, points = SPREADS[name]
    p, c = frames(spark, cells, points)
    got = {r["point_id"]: (r["cell_id"], r["dist"]) for r in nearest_cell(p, c, 2.0, crowd=12).collect()}
    want = brute(cells, points)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_points_of_a_crowd_meet_few_cells(spark):
    rng = np.random.default_rng(4)
    cells = np.vstack([rng.normal(0, 1e-4, (3000, 2)), rng.uniform(-500, 500, (500, 2))])
    points = np.vstack([rng.normal(0, 1e-4, (300, 2)), rng.uniform(-500, 500, (100, 2))])
    p, c = frames(spark, cells, points)
    lists = candidates(p.withColumnsRenamed({"x": "__px", "y": "__py"}), Pyramid(c, [], 20.0, -600.0, -600.0), 6, crowd=40)
    met = [r["n"] for f in lists.values() for r in f.select(F.aggregate("b", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n")).collect()]
    assert max(met) <= 40 and len(lists) > 3


def test_nearest_without_cells_or_coordinates(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, None, 1.0, "a"), (3, float("nan"), 1.0, "a"), (4, 5.0, float("inf"), "a"), (5, 1.0, 1.0, "b")], "point_id long, x double, y double, k string")
    c = spark.createDataFrame([(7, 1.0, 0.0, "a"), (6, 1.0, 0.0, "a"), (9, None, 0.0, "a"), (8, 0.0, 0.0, "c")], "cell_id long, x double, y double, k string")
    got = {r["point_id"]: (r["cell_id"], r["dist"]) for r in nearest_cell(p, c, 1.0, by=["k"]).collect()}
    assert got == {1: (6, 1.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert [tuple(r) for r in nearest_cell(p, c.limit(0), 1.0).select("cell_id", "dist").distinct().collect()] == [(None, None)]
    assert nearest_cell(p.limit(0), c, 1.0).count() == 0
