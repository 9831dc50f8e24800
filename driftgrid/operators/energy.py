"""Energy balance of whole frames; each quantity is computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions import domain as dom
from driftgrid.functions.rand import draw


def update_energy(df: DataFrame, temp: Column, activity: Column, cost: Column, ed: str = "ed_kJ_g", mass: str = "mass_g",
                  ed_tissue=dom.ED_TISSUE, ed_mortal=dom.ED_MORTAL, mass_floor=dom.MASS_FLOOR) -> DataFrame:
    """Add new_ed, new_mass and dead after one hour of respiration.

    The same balance as functions.domain.update_energy. The steps are separate projections, because
    each reads the one before it several times.
    """
    out = df.withColumn("__total", F.col(ed) * 1000.0 * F.col(mass))
    out = out.withColumn("__used", dom.hourly_respiration(F.col(mass), temp, activity) * cost)
    out = out.withColumn("__left", F.greatest(F.col("__total") - F.col("__used"), F.lit(0.0)))
    out = out.withColumn("new_mass", F.greatest(F.col(mass) - (F.col("__total") - F.col("__left")) / F.lit(ed_tissue * 1000.0), F.col(mass) * F.lit(mass_floor)))
    new_ed = F.when(F.col("new_mass") > 0, F.col("__left") / (F.greatest(F.col("new_mass"), F.lit(1e-12)) * 1000.0)).otherwise(0.0)
    out = out.withColumn("new_ed", new_ed)
    return out.withColumn("dead", F.col("new_ed") < F.lit(ed_mortal)).drop("__total", "__used", "__left")


def choose_behaviour(df: DataFrame, temp: Column, hours: Column, table, seed: int, stream: str = "behaviour", keys=("agent_id",)) -> DataFrame:
    """Set behavior by one keyed draw per row from the behaviour table."""
    out = draw(df, "__u", seed, stream, *keys).withColumns({"__temp": temp, "__hours": hours})
    return (out.withColumn("behavior", dom.pick_behaviour(F.col("__temp"), F.col("__hours"), F.col("__u"), table))
            .drop("__u", "__temp", "__hours"))
