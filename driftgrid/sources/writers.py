"""Writers. Each is one DataFrameWriter call, so output stays partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid import schemas


def write_tracks(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """One row per (time, individual), partitioned by time in parquet, or CSV with a header."""
    if fmt == "csv":
        cols = [f.name for f in schemas.TRACKS.fields if f.name in df.columns]
        df.select(*cols).write.mode(mode).option("header", True).csv(path)
    else:
        # Rows of a step meet before the write, and a step too large for one file is split again.
        df.hint("rebalance", "time").write.mode(mode).partitionBy("time").parquet(path)


def write_snapshot(df: DataFrame, directory: str | None, prefix: str = "snapshot", mode: str = "append") -> None:
    """Position, state, energy and mass per step; no directory, no output."""
    if directory is None:
        return
    df.select("time", *schemas.SNAPSHOT).hint("rebalance", "time").write.mode(mode).partitionBy("time").parquet(f"{directory}/{prefix}")


def write_reports(reports: dict, directory: str, tallies: dict | None = None, mode: str = "overwrite") -> list[str]:
    """Each named report as CSV with a header (an empty one is left out), each tally as parquet.

    Returns the names written.
    """
    done = []
    for name, df in reports.items():
        if df.isEmpty():
            continue
        df.write.mode(mode).option("header", True).csv(f"{directory}/{name}.csv")
        done.append(name)
    for name, df in (tallies or {}).items():
        df.write.mode(mode).parquet(f"{directory}/{name}")
        done.append(name)
    return done


def write_layer_csv(df: DataFrame, path: str, value: str = "value", skip_zeros: bool = True, mode: str = "overwrite") -> None:
    """Hex ID counted from one and the score with six decimals."""
    rows = df.filter(F.col(value) != 0) if skip_zeros else df
    (rows.select((F.col("cell_id") + 1).alias("Hex ID"), F.format_string("%f", F.col(value)).alias("Score"))
     .write.mode(mode).option("header", True).csv(path))


def write_edge_outcomes(df: DataFrame, path: str, note: str = "", mode: str = "overwrite") -> None:
    """Edges with four-decimal probabilities and a note."""
    def four(c, name):
        return F.format_string("%.4f", F.col(c)).alias(name)
    (df.select(F.col("from_id").alias("from_h3"), F.col("to_id").alias("to_h3"), four("p_mort", "mortality"), four("p_defl", "deflection"),
               four("p_trans", "transmission"), F.lit(note).alias("note")).write.mode(mode).option("header", True).csv(path))
