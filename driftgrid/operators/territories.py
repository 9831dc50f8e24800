"""Territories: ranges(owner, cell_id) with unique cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.plans.lineage import cut


def expansion_candidates(ranges: DataFrame, edges: DataFrame, layer: DataFrame, value: str, threshold: float, most: int) -> DataFrame:
    """(owner, cell_id, worth, room): free neighbours good enough for owners below the limit."""
    room = (ranges.groupBy("owner").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < most)
            .select("owner", (F.lit(most) - F.col("__n")).alias("room")))
    near = (ranges.join(room, "owner").join(edges.select(F.col("src").alias("cell_id"), "dst"), "cell_id")
            .select("owner", "room", F.col("dst").alias("cell_id")).distinct()
            .join(ranges.select("cell_id"), "cell_id", "left_anti"))
    return (near.join(layer.select("cell_id", F.col(value).alias("worth")), "cell_id").filter(F.col("worth") >= threshold)
            .select("owner", "cell_id", "worth", "room"))


def expand_ranges(ranges: DataFrame, edges: DataFrame, layer: DataFrame, value: str, threshold: float = 0.0,
                  most: int = 50, sort: bool = True) -> DataFrame:
    """Newly claimed (owner, cell_id): each owner takes its best free neighbours up to most cells.

    Owners choose as if served one after the other by id. That serial order is reached by proposals:
    owners propose their best remaining cells, a cell keeps the smallest owner, and every candidate
    of a larger owner for that cell is dropped; rounds end when nothing is dropped. With sort=False
    an owner takes cells in id order. An owner below the limit has fewer than most x degree
    candidates, which bounds the window of one owner.
    """
    cand = cut(expansion_candidates(ranges, edges, layer, value, threshold, most))
    best = [F.col("worth").desc(), F.col("cell_id")] if sort else [F.col("cell_id")]
    w = Window.partitionBy("owner").orderBy(*best)
    while True:
        prop = cut(cand.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= F.col("room")).drop("__r"))
        held = prop.groupBy("cell_id").agg(F.min("owner").alias("keeper"))
        lost = cut(cand.join(held, "cell_id").filter(F.col("owner") > F.col("keeper")).select("owner", "cell_id"))
        if lost.join(prop, ["owner", "cell_id"], "left_semi").isEmpty():
            return prop.select("owner", "cell_id")
        cand = cut(cand.join(lost, ["owner", "cell_id"], "left_anti"))


def contract_ranges(ranges: DataFrame, layer: DataFrame, value: str, threshold: float) -> DataFrame:
    """Ranges without the cells whose value is below the threshold."""
    poor = layer.filter(F.col(value) < threshold).select("cell_id")
    return ranges.join(poor, "cell_id", "left_anti")


def release(ranges: DataFrame, owners: DataFrame) -> DataFrame:
    """Ranges without any cell of the given owners."""
    return ranges.join(owners.select("owner"), "owner", "left_anti")
