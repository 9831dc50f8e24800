"""Set operations over populations and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.plans.ordered import ranked_by_value

# Defaults of a new individual.
DEFAULTS = {"mass_g": 3500.0, "ed_kJ_g": 6.5, "target_spawn_hour": 720, "behavior": 0, "cwr_hours": 0, "hours_since_cwr": 999,
            "steps": 0, "alive": True, "arrived": False, "been_to_sea": False, "natal": -1, "exit_branch": -1,
            "origin": 0, "sea_age": -1, "group_id": -1}


def with_defaults(new: DataFrame, like: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Give new rows every column of like: own value, then the default, then zero."""
    known = {**DEFAULTS, **(defaults or {})}
    types = dict(like.dtypes)

    def column(name):
        if name in new.columns:
            return F.col(name).cast(types[name]).alias(name)
        if name in known:
            return F.lit(known[name]).cast(types[name]).alias(name)
        if types[name].startswith("array"):
            return F.array(*[F.lit(15.0)] * 3).alias(name)       # temperature history
        return F.lit(0).cast(types[name]).alias(name)
    return new.select(*[column(c) for c in like.columns])


def add_agents(df: DataFrame, new: DataFrame, defaults: dict | None = None) -> DataFrame:
    return df.unionByName(with_defaults(new, df, defaults))


def shared_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that hold a living member of both populations."""
    return a.filter("alive").select("cell").intersect(b.filter("alive").select("cell"))


def claim_first(claims: DataFrame) -> DataFrame:
    """Each cell goes to its claim of smallest priority."""
    return claims.groupBy("cell_id").agg(F.min_by("region", F.struct("priority", "region")).alias("region"))


def unmatched(cells: DataFrame, matched: DataFrame, default: str) -> DataFrame:
    """Water cells without a region get the default one."""
    return (cells.filter("water").select("cell_id").join(matched.select("cell_id"), "cell_id", "left_anti")
            .withColumn("region", F.lit(default)))


def rank_frontier(frontier: DataFrame, layer: DataFrame, value: str, threshold: float, most: int) -> DataFrame:
    """Best cells of each individual's frontier by value, ties by cell; most is the range limit.

    A rank that is filtered to a small limit keeps at most that many rows of an individual per task before anything is shuffled,
    so a wide frontier does not have to fit one task. Above the limit that the optimizer cuts early, the rank itself is distributed.
    """
    worth = (frontier.select("agent_id", "cell_id").distinct()
             .join(layer.select("cell_id", F.col(value).alias("worth")), "cell_id").filter(F.col("worth") >= threshold))
    if most <= int(worth.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        out = worth.withColumn("rank", F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("worth"), "cell_id")).cast("long"))
    else:
        out = ranked_by_value(worth, ["agent_id"], "worth", "cell_id", descending=True)
    return out.filter(F.col("rank") <= most).select("agent_id", "cell_id", "worth", "rank")
