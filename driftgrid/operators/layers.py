"""Static layers: derived layers, splits, affinity, gradients of a layer's own values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names a derived layer may not take.
PROTECTED = {"fields", "mesh", "cells", "cell_id", "n_cells", "t", "density", "rng", "global_variables"}


def derived_layer(layers: DataFrame, name: str, expr: str, t: int = 0, agents: DataFrame | None = None) -> DataFrame:
    """Add layer name = expr over the named layers, t, and the live density per cell.

    layers is wide, one column per layer. Density joins only when the expression reads it.
    """
    if name in PROTECTED:
        raise ValueError(f"layer name {name!r} is protected")
    out = layers.withColumn("t", F.lit(t))
    if agents is not None and "density" in expr:
        live = agents.filter("alive").groupBy(F.col("cell").alias("cell_id")).agg(F.count(F.lit(1)).cast("double").alias("density"))
        out = out.join(live, "cell_id", "left").fillna(0.0, ["density"])
    return out.withColumn(name, F.expr(expr).cast("double")).select(*layers.columns, name)


def set_affinity(df: DataFrame, column: str, strength: float, layer: str | None = None, layer_names=(), mask=None) -> DataFrame:
    """Constant affinity on the masked rows; a named layer that does not exist changes nothing."""
    if layer is not None and layer not in layer_names:
        return df
    mask = F.lit(True) if mask is None else mask
    return df.withColumn(column, F.when(mask, F.lit(float(strength))).otherwise(F.col(column)))


def split_by_fraction(df: DataFrame, quantity: str, fractions: dict, label: str = "branch") -> DataFrame:
    """One row per branch with its share; the fractions are a literal and must sum to 1."""
    if abs(sum(fractions.values()) - 1.0) > 1e-6:
        raise ValueError("fractions must sum to 1")
    parts = F.array(*[F.struct(F.lit(n).alias(label), F.lit(float(v)).alias("fraction")) for n, v in fractions.items()])
    return (df.withColumn("__p", F.explode(parts))
            .select(*df.columns, F.col(f"__p.{label}").alias(label), (F.col(quantity) * F.col("__p.fraction")).alias("share"))
            )


def negated_gradient(layer: DataFrame, value: str, out: str = "gradient") -> DataFrame:
    """-value / max(value); a maximum that is not positive counts as 1."""
    top = layer.agg(F.max(value)).scalar()
    return layer.withColumn(out, -F.col(value) / F.when(top <= 0, F.lit(1.0)).otherwise(top))


def trust_region_mask(cells: DataFrame) -> DataFrame:
    """A dry cell that carries a region becomes water at least 1 deep."""
    dry = (F.col("region_id") != -1) & ~F.col("water")
    return cells.withColumns({"depth": F.when(dry, F.greatest(F.col("depth"), F.lit(1.0))).otherwise(F.col("depth")),
                              "water": F.col("water") | dry})


def layer_downsample(layer: DataFrame, value: str, row_step: int, col_step: int) -> DataFrame:
    """Mean value per block of row_step x col_step cells."""
    return (layer.groupBy(F.expr(f"row div {row_step}").alias("block_row"), F.expr(f"col div {col_step}").alias("block_col"))
            .agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_cells")))
