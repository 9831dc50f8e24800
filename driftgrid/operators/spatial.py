"""Sampling polygons, rasters, lattices and triangle meshes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.operators.nearest import nearest_cell
from driftgrid.plans.lineage import cut
from driftgrid.plans.ordered import ranked
from driftgrid.plans.skew import shuffled

SIDES = 32              # sides of a polygon that one tile may hold before it is quartered
DEEPEST = 30            # quarterings of the whole
M_PER_DEG = 111000.0    # metres per degree used for lattice spacing


def ring_edges(rings: DataFrame) -> DataFrame:
    """rings(region, priority, ring, seq, x, y) -> one row per side, the last joining the first."""
    n = rings.groupBy("region", "ring").agg(F.count(F.lit(1)).alias("n"))
    a = rings.join(n, ["region", "ring"]).withColumn("next", (F.col("seq") + 1) % F.col("n"))
    b = rings.select("region", "ring", F.col("seq").alias("next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(b, ["region", "ring", "next"]).select("region", "priority", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def _hits(side, x: Column, y: Column, upto: Column) -> Column:
    """The side meets the ray from (x, y) to the right, not beyond `upto`; a side owns its lower end."""
    over = (side["y1"] > y) != (side["y2"] > y)
    at = (side["x2"] - side["x1"]) * (y - side["y1"]) / F.nullif(side["y2"] - side["y1"], F.lit(0.0)) + side["x1"]
    return F.coalesce(over & (x < at) & (at <= upto), F.lit(False))


def _turns(side, x: Column, a: Column, b: Column) -> Column:
    """The side crosses the vertical line x between the heights a and b."""
    over = (side["x1"] > x) != (side["x2"] > x)
    at = (side["y2"] - side["y1"]) * (x - side["x1"]) / F.nullif(side["x2"] - side["x1"], F.lit(0.0)) + side["y1"]
    return F.coalesce(over & ((at > a) != (at > b)), F.lit(False))


def _touches(side, left: Column, low: Column, width: Column) -> Column:
    """The side meets the closed square."""
    right, top = left + width, low + width
    box = ((F.least(side["x1"], side["x2"]) <= right) & (F.greatest(side["x1"], side["x2"]) >= left)
           & (F.least(side["y1"], side["y2"]) <= top) & (F.greatest(side["y1"], side["y2"]) >= low))
    turn = [(side["x2"] - side["x1"]) * (y - side["y1"]) - (side["y2"] - side["y1"]) * (x - side["x1"]) for x in (left, right) for y in (low, top)]
    return box & (F.least(*turn) <= 0) & (F.greatest(*turn) >= 0)


class Tiles:
    """Squares of a common grid; those of level k are 2^k times smaller than the whole."""

    def __init__(self, x0: float, y0: float, extent: float):
        self.x0, self.y0, self.extent = x0, y0, extent

    def width(self, level: Column) -> Column:
        return F.lit(self.extent) / F.pow(F.lit(2.0), level)

    def left(self, tile: Column, level: Column) -> Column:
        return F.lit(self.x0) + tile * self.width(level)

    def low(self, tile: Column, level: Column) -> Column:
        return F.lit(self.y0) + tile * self.width(level)

    def middle(self, tile: Column, level: Column) -> Column:
        return F.lit(self.y0) + (tile + F.lit(0.5)) * self.width(level)

    def of(self, x: Column, y: Column, level: Column) -> list[Column]:
        return [F.floor((x - F.lit(self.x0)) / self.width(level)).cast("long"), F.floor((y - F.lit(self.y0)) / self.width(level)).cast("long")]


SIDE = ("x1", "y1", "x2", "y2")
TILE = ("region", "priority", "level", "tx", "ty")


def tile_cover(rings: DataFrame, most: int = SIDES) -> tuple[DataFrame, Tiles] | None:
    """(region, priority, level, tx, ty, odd, sides): the tiles that meet a polygon, each with at most `most` sides, and their grid.

    A polygon begins with the few tiles of about its own size. Tiles with more sides are quartered, level by level; what
    is inside without a side is kept whole, what is outside goes. odd says whether the ray to the right from the middle of the tile's
    right edge meets an odd number of sides. A child gets it from its parent's by counting the parent's sides between the two places, so no
    tile ever looks at the whole polygon. Tiles DEEPEST levels down keep all their sides.
    """
    sides = cut(ring_edges(rings).filter(" AND ".join(f"abs({c}) < double('inf')" for c in SIDE)))
    ends = [F.least(F.min(f"{c}1"), F.min(f"{c}2")).alias(f"{c}0") for c in "xy"] + [F.greatest(F.max(f"{c}1"), F.max(f"{c}2")).alias(f"{c}3") for c in "xy"]
    box = sides.agg(*ends).first()
    if box["x0"] is None:
        return None
    grid = Tiles(box["x0"], box["y0"], max(box["x3"] - box["x0"], box["y3"] - box["y0"], 1e-300) * 1.001)
    own = F.greatest(F.col("x3") - F.col("x0"), F.col("y3") - F.col("y0"))
    level = F.when(own > 0, F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.floor(F.log2(F.lit(grid.extent) / own))))).otherwise(DEEPEST).cast("int")
    span = sides.groupBy("region", "priority").agg(*ends).withColumn("level", level)
    (ax, ay), (bx, by) = (grid.of(F.col(f"x{i}"), F.col(f"y{i}"), F.col("level")) for i in (0, 3))
    roots = (span.select("region", "priority", "level", F.explode(F.sequence(ax, bx)).alias("tx"), ay.alias("a"), by.alias("b"))
             .select("region", "priority", "level", "tx", F.explode(F.sequence("a", "b")).alias("ty")))
    side = {c: F.col(c) for c in SIDE}
    here = [F.col("tx"), F.col("ty"), F.col("level")]
    right, middle = grid.left(here[0] + 1, here[2]), grid.middle(here[1], here[2])
    inside = _touches(side, grid.left(here[0], here[2]), grid.low(here[1], here[2]), grid.width(here[2]))
    rows = cut(sides.join(roots, ["region", "priority"]).select(*TILE, *SIDE, _hits(side, right, middle, F.lit(float("inf"))).alias("flip"), inside.alias("touch"), F.lit(False).alias("was")))
    leaves = []
    while True:
        tiles = rows.groupBy(*TILE).agg(F.sum(F.col("touch").cast("long")).alias("n"), (F.sum(F.col("flip").cast("long")) % 2 == 1).alias("odd"), F.max("was").alias("was"))
        tiles = cut(tiles.withColumn("odd", F.col("odd") != F.col("was")).drop("was").filter("n > 0 OR odd"))
        touching = rows.filter("touch").select(*TILE, *SIDE)
        full = (F.col("n") > most) & (F.col("level") < DEEPEST)
        leaves.append(tiles.filter(~full).select(*TILE, "odd").join(touching, list(TILE), "left")
                      .groupBy(*TILE, "odd").agg(F.collect_list(F.when(F.col("x1").isNotNull(), F.struct(*SIDE))).alias("sides")))
        split = tiles.filter(full)
        if split.isEmpty():
            break
        quarter = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
        rows = touching.join(split.select(*TILE, "odd"), list(TILE)).withColumn("q", F.explode(quarter))
        cx, cy, deeper = F.col("tx") * 2 + F.col("q.i"), F.col("ty") * 2 + F.col("q.j"), F.col("level") + 1
        new_right, new_middle = grid.left(cx + 1, deeper), grid.middle(cy, deeper)
        flip = _hits(side, new_right, new_middle, right).cast("int") + _turns(side, right, middle, new_middle).cast("int") == 1
        inside_child = _touches(side, grid.left(cx, deeper), grid.low(cy, deeper), grid.width(deeper))
        rows = cut(rows.select("region", "priority", deeper.cast("int").alias("level"), cx.alias("tx"), cy.alias("ty"), *SIDE, flip.alias("flip"), inside_child.alias("touch"), F.col("odd").alias("was")))
    return cut(reduce(DataFrame.unionByName, leaves)), grid


def polygons_of_points(points: DataFrame, rings: DataFrame, most: int = SIDES) -> DataFrame:
    """(point_id, region, priority) for every polygon that contains the point; holes are honoured.

    An odd number of sides to the right of a point means inside. Points join the tiles that polygons cover by equality and
    test only the sides of their tile, at most `most`; tiles inside a polygon have none to test. A point without finite
    coordinates is in no polygon.
    """
    cover = tile_cover(rings, most)
    if cover is None:
        kinds = dict(rings.dtypes)
        return points.select("point_id", F.lit(None).cast(kinds["region"]).alias("region"), F.lit(None).cast(kinds["priority"]).alias("priority")).limit(0)
    leaves, grid = cover
    levels = [r["level"] for r in leaves.select("level").distinct().collect()]
    p = points.select("point_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).filter("abs(px) < double('inf') AND abs(py) < double('inf')")
    at = F.array(*[F.struct(F.lit(k).alias("level"), *[c.alias(n) for c, n in zip(grid.of(F.col("px"), F.col("py"), F.lit(k)), ("tx", "ty"), strict=True)]) for k in levels])
    met = p.withColumn("a", F.explode(at)).select("point_id", "px", "py", "a.*").join(leaves, ["level", "tx", "ty"])
    right, middle = grid.left(F.col("tx") + 1, F.col("level")), grid.middle(F.col("ty"), F.col("level"))
    n = F.size(F.filter("sides", lambda s: _hits(s, F.col("px"), F.col("py"), right) != _turns(s, right, middle, F.col("py"))))
    return met.filter((n % 2 == 1) != F.col("odd")).select("point_id", "region", "priority")


def point_in_polygon(points: DataFrame, rings: DataFrame, default: int, land: int = -1, most: int = SIDES) -> DataFrame:
    """(point_id, region): first polygon by priority; dry points are land, other water is default."""
    first = (polygons_of_points(points.filter("water"), rings, most).groupBy("point_id")
             .agg(F.min_by("region", "priority").alias("region")))
    out = points.select("point_id", "water").join(first, "point_id", "left")
    return out.select("point_id", F.when(~F.col("water"), F.lit(land)).otherwise(F.coalesce("region", F.lit(default))).alias("region"))


def inside_any(points: DataFrame, rings: DataFrame, name: str, most: int = SIDES) -> DataFrame:
    """points with a flag: inside at least one polygon."""
    hit = polygons_of_points(points, rings, most).select("point_id").distinct().withColumn("__in", F.lit(True))
    return points.join(hit, "point_id", "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__in")


def bilinear(points: DataFrame, grid: DataFrame, origin, step, shape, keys=(), fill: bool = True) -> DataFrame:
    """(point_id, keys..., value) by bilinear interpolation of grid(gi, gj, value, keys...).

    Points carry lat and lon. Outside the grid, or next to a missing node, the value is NaN and, with
    fill, comes from the nearest valid node of the same keys. Nodes are first gathered into grid
    squares, so every point joins one row.
    """
    keys = list(keys)
    (lat0, lon0), (dlat, dlon), (ni, nj) = origin, step, shape
    own = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    valid = grid.filter(~F.isnan("value"))
    sq = valid.withColumn("o", F.explode(own)).select(*keys, (F.col("gi") - F.col("o.a")).alias("i"), (F.col("gj") - F.col("o.b")).alias("j"), "o", "value")
    def corner(a, b):
        return F.max(F.when((F.col("o.a") == a) & (F.col("o.b") == b), F.col("value"))).alias(f"v{a}{b}")
    sq = sq.groupBy(*keys, "i", "j").agg(*[corner(a, b) for a in (0, 1) for b in (0, 1)])
    fi, fj = (F.col("lat") - lat0) / F.lit(dlat), (F.col("lon") - lon0) / F.lit(dlon)
    inside = (fi >= 0) & (fi <= ni - 1) & (fj >= 0) & (fj <= nj - 1)
    i = F.least(F.greatest(F.floor(fi), F.lit(0)), F.lit(ni - 2)).cast("long")
    j = F.least(F.greatest(F.floor(fj), F.lit(0)), F.lit(nj - 2)).cast("long")
    p = points.select("point_id", "lat", "lon", inside.alias("inside"), i.alias("i"), j.alias("j"), fi.alias("fi"), fj.alias("fj"))
    if keys:    # every point has a value in every (time, variable) layer; layers are numbered, and points join the numbers
        layers = cut(ranked(grid.select(*keys).distinct().withColumn("__h", F.xxhash64(*keys)), [], "__h", "__k", ties=keys).drop("__h"))
        p = p.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(layers.count())))).join(layers, "__k").drop("__k")
    out = p.join(sq, [*keys, "i", "j"], "left")
    wi, wj = F.col("fi") - F.col("i"), F.col("fj") - F.col("j")
    value = (F.col("v00") * (1 - wi) * (1 - wj) + F.col("v01") * (1 - wi) * wj + F.col("v10") * wi * (1 - wj) + F.col("v11") * wi * wj)
    out = out.select("point_id", *keys, "lat", "lon", F.coalesce(F.when(F.col("inside"), value), F.lit(float("nan"))).alias("value"))
    if not fill:
        return out.select("point_id", *keys, "value")
    nodes = valid.select(*keys, (F.col("gi") * F.lit(nj) + F.col("gj")).cast("long").alias("cell_id"), (F.lit(lon0) + F.col("gj") * F.lit(dlon)).alias("x"),
                         (F.lit(lat0) + F.col("gi") * F.lit(dlat)).alias("y"), F.col("value").alias("near"))
    gaps = out.filter(F.isnan("value")).select("point_id", *keys, F.col("lon").alias("x"), F.col("lat").alias("y"))
    near = nearest_cell(gaps, nodes, max(dlat, dlon), by=keys).join(nodes.select(*keys, "cell_id", "near"), [*keys, "cell_id"]).select("point_id", *keys, "near")
    return (out.join(near, ["point_id", *keys], "left")
            .select("point_id", *keys, F.when(F.isnan("value"), F.coalesce("near", F.col("value"))).otherwise(F.col("value")).alias("value")))


def nearest_raster(points: DataFrame, raster: DataFrame, bbox, shape) -> DataFrame:
    """(point_id, value) at the truncated, clipped row and column; row 0 is the north; NaN becomes 0."""
    minlon, minlat, maxlon, maxlat = bbox
    h, w = shape
    row = ((F.lit(maxlat) - F.col("lat")) / F.lit(max(maxlat - minlat, 1e-9)) * (h - 1)).cast("long")
    col = ((F.col("lon") - F.lit(minlon)) / F.lit(max(maxlon - minlon, 1e-9)) * (w - 1)).cast("long")
    p = points.select("point_id", F.least(F.greatest(row, F.lit(0)), F.lit(h - 1)).alias("row"), F.least(F.greatest(col, F.lit(0)), F.lit(w - 1)).alias("col"))
    out = p.join(raster.select("row", "col", "value"), ["row", "col"], "left")
    return out.select("point_id", F.when(F.col("value").isNull() | F.isnan("value"), 0.0).otherwise(F.col("value")).alias("value"))


def node_to_cell_mean(field: DataFrame, triangles: DataFrame, value: str = "value", keys=("t",)) -> DataFrame:
    """(tri, keys..., value): mean of the three node values; NaN where a node has none."""
    nodes = triangles.select("tri", F.explode(F.array("n0", "n1", "n2")).alias("node"))
    out = nodes.join(shuffled(field.select("node", *keys, value)), "node").groupBy("tri", *keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))
    return out.select("tri", *keys, F.when(F.col("n") == 3, F.col(value)).otherwise(F.lit(float("nan"))).alias(value))


def regular_grid(spark, minlat: float, minlon: float, maxlat: float, maxlon: float, metres: float) -> DataFrame:
    """(node, lat, lon) lattice with metric spacing at the middle latitude, generated in parallel."""
    dlat = metres / M_PER_DEG
    dlon = metres / (M_PER_DEG * math.cos(math.radians(0.5 * (minlat + maxlat))))
    ni = math.ceil((maxlat + dlat / 2 - minlat) / dlat)
    nj = math.ceil((maxlon + dlon / 2 - minlon) / dlon)
    i, j = F.expr(f"id div {nj}"), F.col("id") % nj
    return spark.range(ni * nj).select(F.col("id").alias("node"), (F.lit(minlat) + i * F.lit(dlat)).alias("lat"), (F.lit(minlon) + j * F.lit(dlon)).alias("lon"))
