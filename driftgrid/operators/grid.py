"""Hexagonal offset grids: adjacency, centres, distance, and the water subgraph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.plans.skew import shuffled

# Neighbour offsets (row, col) per row parity, pointy-top, odd rows shifted right.
EVEN_OFFSETS = [(-1, -1), (-1, 0), (0, -1), (0, 1), (1, -1), (1, 0)]
ODD_OFFSETS = [(-1, 0), (-1, 1), (0, -1), (0, 1), (1, 0), (1, 1)]


def flat_id(row: Column, col: Column, width: int, narrow: bool = False) -> Column:
    """Row-major id; on a narrow grid odd rows hold one cell less."""
    if not narrow:
        return row * width + col
    return F.floor(row / 2).cast("long") * (2 * width - 1) + F.when(row % 2 == 1, width).otherwise(0) + col


def row_col(flat: Column, width: int, narrow: bool = False) -> tuple[Column, Column]:
    """Inverse of flat_id."""
    if not narrow:
        return F.floor(flat / width).cast("long"), flat % width
    pair, rest = F.floor(flat / (2 * width - 1)).cast("long"), flat % (2 * width - 1)
    odd = rest >= width
    return pair * 2 + odd.cast("long"), F.when(odd, rest - width).otherwise(rest)


def hex_adjacency(cells: DataFrame, width: int, narrow: bool = False) -> DataFrame:
    """(src, dst, slot) for every neighbour that is itself in cells(cell_id, row, col).

    Each cell proposes its six offsets; a semi join on the id keeps those that exist.
    """
    def offsets(table):
        return F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(r).alias("dr"), F.lit(c).alias("dc"))
                         for i, (r, c) in enumerate(table)])
    nbr = (cells.select("cell_id", "row", "col",
                        F.explode(F.when(F.col("row") % 2 == 0, offsets(EVEN_OFFSETS))
                                  .otherwise(offsets(ODD_OFFSETS))).alias("o"))
           .select(F.col("cell_id").alias("src"), (F.col("row") + F.col("o.dr")).alias("nr"),
                   (F.col("col") + F.col("o.dc")).alias("nc"), F.col("o.slot").alias("slot")))
    limit = F.lit(width) - (F.col("nr") % 2 if narrow else F.lit(0))
    nbr = nbr.filter((F.col("nr") >= 0) & (F.col("nc") >= 0) & (F.col("nc") < limit))
    nbr = nbr.select("src", flat_id(F.col("nr"), F.col("nc"), width, narrow).cast("long").alias("dst"), "slot")
    return nbr.join(shuffled(cells.select(F.col("cell_id").alias("dst"))), "dst", "left_semi").select("src", "dst", "slot")


def water_edges(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges whose two endpoints are both water; an unknown endpoint is not water."""
    wet = cells.filter("water").select("cell_id")
    return (edges.join(shuffled(wet.withColumnRenamed("cell_id", "src")), "src", "left_semi")
            .join(shuffled(wet.withColumnRenamed("cell_id", "dst")), "dst", "left_semi")
            .select(*edges.columns))


def hex_centres(cells: DataFrame, edge: float = 1.0) -> DataFrame:
    """Add x, y of the pointy-top centre."""
    return cells.select("*",
                        (F.lit(math.sqrt(3.0) * edge) * (F.col("col") + F.lit(0.5) * (F.col("row") % 2))).alias("x"),
                        (F.lit(1.5 * edge) * F.col("row")).alias("y"))


def hex_vertices(cells: DataFrame, edge: float = 1.0) -> DataFrame:
    """Six corner rows (cell_id, corner, vx, vy) per cell with x and y."""
    corners = F.array(*[F.struct(F.lit(k).alias("corner"),
                                 F.lit(edge * math.cos(math.radians(60 * k - 30))).alias("dx"),
                                 F.lit(edge * math.sin(math.radians(60 * k - 30))).alias("dy")) for k in range(6)])
    return (cells.select("cell_id", "x", "y", F.explode(corners).alias("c"))
            .select("cell_id", "c.corner", (F.col("x") + F.col("c.dx")).alias("vx"),
                    (F.col("y") + F.col("c.dy")).alias("vy")))


def cube(row: Column, col: Column, layout: str = "odd-row") -> tuple[Column, Column]:
    """Cube coordinates (q, r) of an offset cell; odd-q shifts columns instead of rows."""
    if layout == "odd-row":
        return col - F.floor((row - row % 2) / 2).cast("long"), row
    return col, row - F.floor((col - col % 2) / 2).cast("long")


def hex_distance(row_a, col_a, row_b, col_b, layout: str = "odd-row") -> Column:
    """Number of hops between two cells."""
    qa, ra = cube(row_a, col_a, layout)
    qb, rb = cube(row_b, col_b, layout)
    dq, dr = qa - qb, ra - rb
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))
