"""Exact quantiles per group without holding a group in one task.

Selection in two passes over the rows. A mergeable sketch brackets each wanted rank: its error is at most one
part in ACCURACY of the group. Then rows below the bracket are counted and the values inside it are counted one by one, so that a few
parts in ACCURACY of a group's values are ever ordered, wherever on their axis the values crowd. Linear
interpolation between neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.plans.spans import matched

ACCURACY = 10_000


def quantiles(df: DataFrame, keys, value: str, wanted: dict, *, also: dict[str, Column] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with {name: q} columns, and {name: aggregate} columns of `also` from the same pass; nulls and NaN are left out.

    Groups of at most `accuracy` rows are ordered whole. For larger ones the bracket reaches three parts in accuracy to both sides
    of the rank, which covers the sketch's error; a rank outside its bracket would raise an error, never a wrong value.
    """
    keys, also, far = list(keys), also or {}, float("inf")
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ends = [min(1.0, max(0.0, q + d / accuracy)) for q in wanted.values() for d in (-3, 3)]
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(value, ends, accuracy).alias("__ends"), *[c.alias(n) for n, c in also.items()])
    if not keys:
        rows, stats = rows.withColumn("__all", F.lit(0)), stats.withColumn("__all", F.lit(0))
    by, small, v = keys or ["__all"], F.col("__n") <= accuracy, F.col(value)
    tests = []
    for i, q in enumerate(wanted.values()):
        lo = F.when(small | F.lit(q - 3 / accuracy <= 0), F.lit(-far)).otherwise(F.col("__ends")[2 * i])
        hi = F.when(small | F.lit(q + 3 / accuracy >= 1), F.lit(far)).otherwise(F.col("__ends")[2 * i + 1])
        tests.append(F.struct(F.lit(i).alias("i"), (v < lo).alias("below"), F.when((v >= lo) & (v <= hi), v).alias("v")))
    met = (matched(rows.select(*by, value), stats.select(*by, "__n", "__ends"), by, "inner").select(*by, "__n", F.explode(F.array(*tests)).alias("t"))
           .filter(F.col("t.below") | F.col("t.v").isNotNull()).groupBy(*by, "t.i", "t.below", "t.v").agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n")))
    w = Window.partitionBy(*by, "i").orderBy(F.desc("below"), "v").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("__cum", F.sum("__c").over(w))
    aggs = []
    for i, (name, q) in enumerate(wanted.items()):
        pos = (F.col("__n") - 1) * F.lit(float(q))
        own, lo, hi = F.col("i") == i, F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(own & ~F.col("below") & (F.col("__cum") > lo), F.col("v"))).alias(f"__lo_{name}"),
                 F.min(F.when(own & ~F.col("below") & (F.col("__cum") > hi), F.col("v"))).alias(f"__hi_{name}"),
                 F.max(F.when(own, pos - lo)).alias(f"__w_{name}"),
                 F.max(own & F.col("below") & (F.col("__cum") > lo)).alias(f"__over_{name}")]
    out = met.groupBy(*by).agg(*aggs)
    if also:
        out = matched(out, stats.select(*by, *also), by, "inner")

    def chosen(n: str) -> Column:
        sure = ~F.col(f"__over_{n}") & F.col(f"__lo_{n}").isNotNull() & F.col(f"__hi_{n}").isNotNull()
        between = F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")
        return F.when(sure, between).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket"))).alias(n)

    return out.select(*keys, *[chosen(n) for n in wanted], *also)
