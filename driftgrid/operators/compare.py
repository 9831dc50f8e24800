"""Run-to-run comparison: census, individuals, space, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.plans.ordered import previous


def rel_error(a: Column, b: Column) -> Column:
    """|a-b|/a; for a = 0, one when b is positive, else zero."""
    return F.when(a > 0, F.abs(a - b) / F.when(a > 0, a)).when(b > 0, 1.0).otherwise(0.0)


def _long(df: DataFrame, metrics) -> DataFrame:
    """Unpivot [(metric, a, b, error)] columns into rows with an error above zero."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), a.cast("double").alias("val_a"), b.cast("double").alias("val_b"),
                              e.cast("double").alias("rel_error")) for m, a, b, e in metrics])
    return (df.select("pop", "step", F.explode(rows).alias("r")).select("pop", "step", "r.*")
            .filter(F.col("rel_error") > 0))


def compare_census(a: DataFrame, b: DataFrame) -> DataFrame:
    """Divergences of size and growth for matching (pop, step).

    a has size and lambda, b has size; growth of b is taken against the previous matched step.
    """
    both = a.select("pop", "step", F.col("size").alias("sa"), F.coalesce("lambda", F.lit(1.0)).alias("la")).join(
        b.select("pop", "step", F.col("size").alias("sb")), ["pop", "step"])
    seen = previous(both, ["pop"], "step", {"prev": "sb"})
    lb = F.when(F.col("prev") > 0, F.col("sb") / F.when(F.col("prev") > 0, F.col("prev"))).otherwise(1.0)
    la = F.col("la")
    err = F.when(la > 0, F.abs(la - lb) / F.when(la > 0, la)).when(lb != 1.0, 1.0).otherwise(0.0)
    return _long(seen, [("size", F.col("sa"), F.col("sb"), rel_error(F.col("sa"), F.col("sb"))), ("lambda", la, lb, err)])


def compare_agents(a: DataFrame, b: DataFrame) -> DataFrame:
    """Divergences of mean energy, mean mass and energy spread per (pop, step)."""
    def stats(df, s):
        return df.groupBy("pop", "step").agg(F.count("ed").alias(f"n{s}"), F.avg("ed").alias(f"ed{s}"), F.avg("mass").alias(f"mass{s}"),
                                             F.count("mass").alias(f"m{s}"), F.stddev_pop("ed").alias(f"sd{s}"))
    both = stats(a, "a").join(stats(b, "b"), ["pop", "step"])
    def metric(name, x, ok):
        va, vb = F.col(f"{x}a"), F.col(f"{x}b")
        return name, va, vb, F.when(ok, rel_error(va, vb)).otherwise(0.0)
    some = (F.col("na") > 0) & (F.col("nb") > 0)
    return _long(both, [metric("mean_ed", "ed", some), metric("mean_mass", "mass", (F.col("ma") > 0) & (F.col("mb") > 0)),
                        metric("std_ed", "sd", (F.col("na") > 1) & (F.col("nb") > 1))])


def spatial_jsd(a: DataFrame, b: DataFrame, keys=("time",)) -> DataFrame:
    """Base-2 Jensen-Shannon divergence of the cell histograms of each key."""
    keys = list(keys)
    def hist(df, s):
        return df.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias(f"n{s}"))
    def size(df, s):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"t{s}"))
    both = (hist(a, "a").join(hist(b, "b"), [*keys, "cell"], "full").join(size(a, "a"), keys).join(size(b, "b"), keys))
    p = F.coalesce("na", F.lit(0)) / F.col("ta")
    q = F.coalesce("nb", F.lit(0)) / F.col("tb")
    def part(x, other):
        return F.when(x > 0, x * F.log2(x / ((x + other) / 2))).otherwise(0.0)
    return both.groupBy(*keys).agg((F.sum(part(p, q) + part(q, p)) / 2).alias("jsd"))


def verdict(census: DataFrame, agents: DataFrame) -> DataFrame:
    """One row: FAIL, WARN or PASS."""
    size = census.agg(F.coalesce(F.bool_or((F.col("metric") == "size") & (F.col("rel_error") > 0.05) &
                                           (F.abs(F.col("val_a") - F.col("val_b")) > 10)), F.lit(False)).alias("size_fail"))
    worst = agents.agg(F.coalesce(F.max("rel_error"), F.lit(0.0))).scalar()
    return (size.withColumn("worst", worst)
            .select(F.when(F.col("size_fail") | (F.col("worst") > 0.15), "FAIL").when(F.col("worst") > 0.05, "WARN")
                    .otherwise("PASS").alias("verdict")))


def energy_loss(tracks: DataFrame, group: str) -> DataFrame:
    """Mean share of the initial energy lost and the share that died, per group of individuals."""
    each = tracks.groupBy("agent_id", group).agg(F.min_by("ed_kJ_g", "time").alias("first"), F.max_by("ed_kJ_g", "time").alias("last"),
                                                 F.bool_and("alive").alias("lived"))
    return each.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("first") - F.col("last")) / F.col("first")).alias("mean_loss"),
                                   F.avg((~F.col("lived")).cast("double")).alias("mortality"))
