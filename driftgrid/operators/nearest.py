"""Nearest cell of every point, over a pyramid of occupied buckets.

Buckets of a level halve in width from one level to the next finer one. Cells are only counted per bucket; what
travels is a region (a bucket that holds points) with the buckets that may hold the nearest cell of any point in
it. Regions climb until their own bucket is occupied and descend while their buckets hold many cells, so the
few cells that a point meets at the end do not depend on how points or cells are spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.plans.lineage import cut
from driftgrid.plans.skew import shuffled

CROWD = 64              # cells that the buckets of a region may hold together before the region is split
RING = 2                # a cell in the region's own bucket is nearer than any bucket further out
FINEST = -40            # halvings of the given width after which coordinates can't be told apart


class Pyramid:
    """Occupied buckets of each level, made when a level is first asked for. Level k has buckets of width size * 2^k."""

    def __init__(self, cells: DataFrame, by: list[str], size: float, x0: float, y0: float):
        self.cells, self.by, self.size, self.x0, self.y0, self.made = cells, by, size, x0, y0, {}

    def place(self, k: int, x: str = "x", y: str = "y") -> list[Column]:
        width = F.lit(self.size * 2.0 ** k)
        return [F.floor((F.col(c) - F.lit(o)) / width).cast("long") for c, o in ((x, self.x0), (y, self.y0))]

    def level(self, k: int) -> DataFrame:
        """(by..., bx, by_, n) of the occupied buckets."""
        if k not in self.made:
            bx, by_ = self.place(k)
            self.made[k] = cut(self.cells.groupBy(*self.by, bx.alias("__bx"), by_.alias("__by")).agg(F.count(F.lit(1)).alias("n")))
        return self.made[k]


def _kept(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of a region (rx, ry) and a bucket (bx, by_, n) that may hold its nearest cell, with totals per region.

    Between any point of the region and any cell of the bucket lie at least the gap and at most the span of the two
    squares; no bucket farther away than the smallest span can matter.
    """
    dx, dy = F.abs(F.col("__bx") - F.col("__rx")), F.abs(F.col("__by") - F.col("__ry"))
    gap = F.pow(F.greatest(dx - 1, F.lit(0)), F.lit(2)) + F.pow(F.greatest(dy - 1, F.lit(0)), F.lit(2))
    span = F.pow(dx + 1, F.lit(2)) + F.pow(dy + 1, F.lit(2))
    packed = pairs.groupBy(*by, "__rx", "__ry").agg(F.min(span).alias("reach"), F.collect_list(F.struct(gap.alias("gap"), "__bx", "__by", "n")).alias("b"))
    near = packed.withColumn("b", F.filter("b", lambda b: b["gap"] <= F.col("reach")))
    return near.withColumns({"cells": F.aggregate("b", F.lit(0).cast("long"), lambda a, b: a + b["n"]), "most": F.array_max(F.transform("b", lambda b: b["n"]))})


def candidates(points: DataFrame, pyramid: Pyramid, top: int, crowd: int = CROWD) -> dict[int, DataFrame]:
    """{level: (by..., rx, ry, b)}: regions of that level with the buckets whose cells their points have to look at.

    Every point whose group has a cell lies in such a region. A bucket list holds a bounded number of buckets: those within two
    of an occupied region, or their children that the bounds leave.
    """
    by = pyramid.by
    ring = [(a, b) for a in range(-RING, RING + 1) for b in range(-RING, RING + 1)]
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ring])
    rx, ry = pyramid.place(0, "__px", "__py")
    open_ = points.select(*by, rx.alias("__rx"), ry.alias("__ry")).distinct()
    done, crowded, k = {}, {}, 0

    def settle(level: int, found: DataFrame) -> None:
        full = (F.col("cells") > crowd) & (F.col("most") > 1) & F.lit(level > FINEST)
        done.setdefault(level, []).append(found.filter(~full).select(*by, "__rx", "__ry", "b"))
        more = found.filter(full).select(*by, "__rx", "__ry", "b")
        if not more.isEmpty():
            crowded.setdefault(level, []).append(more)

    while True:
        here = pyramid.level(k)
        open_ = cut(open_.join(shuffled(here.select(*by, F.col("__bx").alias("__rx"), F.col("__by").alias("__ry"), F.lit(True).alias("own"))), [*by, "__rx", "__ry"], "left"))
        near = (open_.filter("own").drop("own").withColumn("o", F.explode(around))
                .select(*by, "__rx", "__ry", (F.col("__rx") + F.col("o.a")).alias("__bx"), (F.col("__ry") + F.col("o.b")).alias("__by")).join(shuffled(here), [*by, "__bx", "__by"]))
        settle(k, cut(_kept(near, by)))
        open_ = open_.filter("own is null").select(*by, F.shiftright("__rx", 1).alias("__rx"), F.shiftright("__ry", 1).alias("__ry")).distinct()
        if k == top or open_.isEmpty():
            break
        k += 1
    while crowded:
        level = max(crowded)
        parents = reduce(DataFrame.unionByName, crowded.pop(level))
        rx, ry = pyramid.place(level - 1, "__px", "__py")
        up = [F.shiftright(c, 1).alias(c) for c in ("__rx", "__ry")]
        held = points.select(*by, rx.alias("__cx"), ry.alias("__cy"), F.shiftright(rx, 1).alias("__rx"), F.shiftright(ry, 1).alias("__ry")).distinct()
        finer = pyramid.level(level - 1)
        wide = (held.join(shuffled(parents), [*by, "__rx", "__ry"]).select(*by, F.col("__cx").alias("__rx"), F.col("__cy").alias("__ry"), F.explode("b").alias("b"))
                .select(*by, "__rx", "__ry", F.col("b.__bx").alias("__ux"), F.col("b.__by").alias("__uy")))
        below = finer.select(*by, F.shiftright("__bx", 1).alias("__ux"), F.shiftright("__by", 1).alias("__uy"), "__bx", "__by", "n")
        settle(level - 1, cut(_kept(wide.join(shuffled(below), [*by, "__ux", "__uy"]), by)))
    return {level: reduce(DataFrame.unionByName, parts) for level, parts in done.items()}


def nearest_cell(points: DataFrame, cells: DataFrame, size: float, point_key: str = "point_id", by=(), crowd: int = CROWD) -> DataFrame:
    """(point key, by..., cell_id, dist) of the nearest centre for every point; ties go to the smallest id.

    size is the width of the buckets that the search begins with, about the spacing of the cells; it changes the work, never the
    result. by names columns that must match on both sides. A point without finite coordinates, or with no cell to match,
    gets nulls.
    """
    by, far = list(by), float("inf")

    def finite(*names: str) -> Column:
        return reduce(Column.__and__, [F.col(c).isNotNull() & (F.abs(c) < far) for c in names])

    own = points.select(point_key, *by, F.col("x").alias("__px"), F.col("y").alias("__py"))
    good = own.filter(finite("__px", "__py"))
    sites = cells.filter(finite("x", "y")).groupBy(*by, "x", "y").agg(F.min("cell_id").alias("cell_id"))
    ends = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    box, more = sites.agg(*ends).first(), good.select(F.col("__px").alias("x"), F.col("__py").alias("y")).agg(*ends).first()
    none = own.select(point_key, *by, F.lit(None).cast(cells.schema["cell_id"].dataType).alias("cell_id"), F.lit(None).cast("double").alias("dist"))
    if box["x0"] is None or more["x0"] is None:
        return none
    x0, y0 = min(box["x0"], more["x0"]), min(box["y0"], more["y0"])
    extent, top = max(max(box["x1"], more["x1"]) - x0, max(box["y1"], more["y1"]) - y0), 0
    while size * 2.0 ** top <= extent:
        top += 1
    pyramid = Pyramid(cut(sites), by, size, float(x0), float(y0))
    found = candidates(good, pyramid, top, crowd)
    places, levels = [], sorted(found)
    for k in levels:
        bx, by_ = pyramid.place(k)
        lists = (found[k].withColumn("b", F.explode("b")).select(*by, "__rx", "__ry", F.col("b.__bx").alias("__bx"), F.col("b.__by").alias("__by"))
                 .join(shuffled(pyramid.cells.withColumns({"__bx": bx, "__by": by_})), [*by, "__bx", "__by"])
                 .groupBy(*by, "__rx", "__ry").agg(F.collect_list(F.struct("x", "y", "cell_id")).alias("near")))
        places.append(lists.withColumn("__k", F.lit(k)))
    at = F.array(*[F.struct(F.lit(k).alias("__k"), *[c.alias(n) for c, n in zip(pyramid.place(k, "__px", "__py"), ("__rx", "__ry"), strict=True)]) for k in levels])
    seen = good.withColumn("a", F.explode(at)).select(point_key, *by, "__px", "__py", "a.*").join(shuffled(reduce(DataFrame.unionByName, places)), [*by, "__k", "__rx", "__ry"])
    dist = F.transform("near", lambda c: F.struct(F.sqrt(F.pow(c["x"] - F.col("__px"), F.lit(2.0)) + F.pow(c["y"] - F.col("__py"), F.lit(2.0))).alias("dist"), c["cell_id"].alias("cell_id")))
    best = seen.withColumn("m", F.array_min(dist)).groupBy(point_key, *by).agg(F.min("m").alias("m"))
    return own.select(point_key, *by).join(shuffled(best), [point_key, *by], "left").select(point_key, *by, "m.cell_id", "m.dist")
