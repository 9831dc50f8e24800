"""Data-quality checks. Each returns violations (none = pass) or one row of check results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.plans.ordered import previous


def raise_on(violations: DataFrame, what: str) -> None:
    """Turn a violations frame into an error that counts them and shows the first."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {violations.count()} violation(s), e.g. {first[0].asDict()}")


def untagged(df: DataFrame) -> DataFrame:
    """Living individuals on the mesh without a natal region."""
    return df.filter(F.col("alive") & (F.col("cell") >= 0) & (F.col("natal") == -1))


def _finite(c):
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def unit_check(field: DataFrame, value: str, limit: float = 30.0) -> DataFrame:
    """One row: the finite maximum and whether it points to a wrong unit."""
    return (field.agg(F.max(F.when(_finite(value), F.col(value))).alias("finite_max"))
            .withColumn("suspect", F.coalesce(F.col("finite_max") > limit, F.lit(False))))


def zone_table_check(cells: DataFrame, zone_table: DataFrame) -> DataFrame:
    """Zones the cells use against rows of the table: both counts and ok."""
    need = cells.agg((F.greatest(F.max("zone_raw") - 1, F.lit(0)) + 1).cast("long").alias("zones_needed"))
    have = zone_table.select("zone").distinct().agg(F.count(F.lit(1))).scalar()
    return need.withColumn("zones_present", have).withColumn("ok", F.col("zones_needed") == F.col("zones_present"))


def distance_check(cells: DataFrame, dist: str = "dist") -> DataFrame:
    """One row: water cells without a finite distance, the maximum, sources at zero, ok."""
    good = F.col("water") & _finite(dist) & F.col(dist).isNotNull()
    out = cells.agg(
        F.count(F.when(F.col("water"), 1)).alias("n_water"),
        F.count(F.when(F.col("water") & ~F.coalesce(_finite(dist), F.lit(False)), 1)).alias("not_finite"),
        F.max(F.when(good, F.col(dist))).alias("max_dist"),
        F.count(F.when(good & (F.col(dist) == 0), 1)).alias("n_sources"))
    return out.withColumn("ok", (F.col("not_finite") == 0) & (F.col("max_dist") > 0) & (F.col("n_sources") > 0))


def branch_topology(cells: DataFrame, edges: DataFrame, names, branches) -> DataFrame:
    """Problem per branch: unknown name, no cells, or an entry cell without water neighbours."""
    from driftgrid.operators.generation import entry_cells
    spark = cells.sparkSession
    dim = spark.createDataFrame([(b, names.index(b) if b in names else None) for b in branches], "branch string, region_id int")
    deg = edges.groupBy(F.col("src").alias("entry")).agg(F.count(F.lit(1)).alias("deg"))
    entry = entry_cells(cells, edges).join(deg, "entry", "left")
    out = dim.join(entry, "region_id", "left")
    problem = (F.when(F.col("region_id").isNull(), "unknown region").when(F.col("entry").isNull(), "no cells")
               .when(F.coalesce("deg", F.lit(0)) == 0, "entry cell is dry"))
    return out.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("branch", "problem")


def probabilities_sum(df: DataFrame, columns, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose probabilities do not add up to one."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.withColumn("total", total).filter(F.isnan("total") | (F.abs(F.col("total") - 1.0) > tolerance))


def matrix_rows_sum(matrix: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows of a long matrix(row, col, value) that do not add up to one."""
    return (matrix.groupBy("row").agg(F.sum("value").alias("total"))
            .filter(F.isnan("total") | (F.abs(F.col("total") - 1.0) > tolerance)))


def dormant_gradient(df: DataFrame, field: DataFrame, value: str, directed=(3, 4)) -> DataFrame:
    """One row: is any individual directed while the field is zero everywhere?"""
    moving = df.agg(F.coalesce(F.bool_or(F.col("behavior").isin(list(directed))), F.lit(False)).alias("any_directed"))
    flat = field.agg(F.coalesce(~F.bool_or(F.col(value) != 0), F.lit(True))).scalar()
    return moving.withColumn("all_zero", flat).withColumn("dormant", F.col("any_directed") & F.col("all_zero"))


def tagged_dry(cells: DataFrame) -> DataFrame:
    """Dry cells that carry a region, counted per region."""
    return (cells.filter((F.col("region_id") != -1) & ~F.col("water")).groupBy("region_id")
            .agg(F.count(F.lit(1)).alias("n_dry")))


def barrier_ids(edges: DataFrame, n: int, column: str = "hex_id") -> DataFrame:
    return edges.filter((F.col(column) < 0) | (F.col(column) >= n))


def monotone_flags(tracks: DataFrame, flag: str) -> DataFrame:
    """Rows where a sticky flag went back to false."""
    out = previous(tracks, ["agent_id"], "time", {"before": flag})
    return out.filter(F.coalesce(F.col("before"), F.lit(False)) & ~F.col(flag)).drop("before")


def degree(edges: DataFrame, most: int) -> DataFrame:
    """Cells with more neighbours than the grid allows; neighbour arrays rely on this bound."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > most)
