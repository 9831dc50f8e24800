"""Windowed aggregates of position streams, in append mode after the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.operators.reports import step_summary


def _open(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("window.start")).drop("window")


def step_summaries(positions: DataFrame, width: str = "1 hour") -> DataFrame:
    """The step summary per tumbling window."""
    return _open(step_summary(positions.withColumn("window", F.window("ts", width)), keys=("window",)))


def tallies(positions: DataFrame, width: str = "1 hour") -> DataFrame:
    """Living rows per cell and window; occupancy and density are sums over its rows."""
    return _open(positions.filter("alive").groupBy(F.window("ts", width), F.col("cell").alias("cell_id")).agg(F.count(F.lit(1)).alias("n")))


def counts(positions: DataFrame, width: str = "1 hour") -> DataFrame:
    """Rows per window that arrived before the watermark closed it."""
    return _open(positions.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n")))


def occupancy_density(tally: DataFrame) -> DataFrame:
    """Roll up emitted tallies: windows occupied and rows seen per cell."""
    return tally.groupBy("cell_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("n").alias("n"))


def flux(moves: DataFrame) -> DataFrame:
    """Roll up emitted moves: net change per cell."""
    return moves.groupBy("cell_id").agg(F.sum("d").alias("net"))


def co_located(a: DataFrame, b: DataFrame, width: str = "1 hour") -> DataFrame:
    """Cells and windows shared by two streams with the head counts of both.

    Both streams are aggregated together, so crowded cells cost their rows and not their pairs.
    """
    both = a.select("ts", "cell", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("ts", "cell", F.lit(0).alias("a"), F.lit(1).alias("b")))
    out = both.groupBy(F.window("ts", width), "cell").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    return _open(out).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))


def sessions(positions: DataFrame, in_state, gap: str = "6 hours") -> DataFrame:
    """Stretches of rows in a state with no gap longer than gap, per individual."""
    w = F.session_window("ts", gap)
    out = positions.filter(in_state).groupBy("agent_id", w).agg(F.count(F.lit(1)).alias("n"))
    return out.select("agent_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
