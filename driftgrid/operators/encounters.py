"""Encounters of two populations that share cells, without forming the pairs.

Every prey meets every predator of its cell with the same probability, and the first predator that
hits (smallest id) wins. The rank of that predator is therefore geometric: one keyed draw per prey
gives it, and the prey joins the predator of that rank. Work is linear in the rows of both sides
however crowded a cell is, and the distribution is the one of the pairwise dice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.rand import Key, hash_u
from driftgrid.plans.ordered import ranked
from driftgrid.plans.spans import matched, place

TRIAL_BITS = 16         # trials of one table look-up: 65,536 at most


def cell_counts(a: DataFrame, b: DataFrame, keys=("cell",)) -> DataFrame:
    """Living members of a and b per shared cell."""
    na = a.filter("alive").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"))
    nb = b.filter("alive").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
    return na.join(nb, list(keys))


def co_located(a: DataFrame, b: DataFrame, keys=("cell",)) -> DataFrame:
    """Members of both populations in shared cells: (cell, side, agent_id, n_a, n_b), one row each."""
    both = (a.filter("alive").select(*keys, F.lit("a").alias("side"), "agent_id")
            .unionByName(b.filter("alive").select(*keys, F.lit("b").alias("side"), "agent_id")))
    return both.join(cell_counts(a, b, keys), list(keys))


def first_hit(u: Column, p: float) -> Column:
    """0-based rank of the first success in trials of probability p; null when p is 0."""
    if p <= 0.0:
        return F.lit(None).cast("long")
    if p >= 1.0:
        return F.lit(0).cast("long")
    return F.floor(F.log(F.lit(1.0) - u) / F.lit(math.log1p(-p))).cast("long")


def kills(a: DataFrame, b: DataFrame, p: float, seed: int, keys=("cell",), key: Key = "agent_id") -> DataFrame:
    """(cell, predator_id, prey_id): each prey dies at most once, to the smallest hitting id.

    key names columns of the prey; give ("agent_id", "time") with keys=("time", "cell").
    """
    pred = (ranked(a.filter("alive").select(*keys, "agent_id"), list(keys), "agent_id", "__r")
            .select(*keys, (F.col("__r") - 1).alias("__hit"), F.col("agent_id").alias("predator_id")))
    drawn = (b.filter("alive").select(*keys, F.col("agent_id").alias("prey_id"), first_hit(hash_u(seed, "encounter", key), p).alias("__hit"))
             .filter(F.col("__hit").isNotNull()))
    return drawn.join(pred, [*keys, "__hit"]).select(*keys, "predator_id", "prey_id")


def survivors(b: DataFrame, killed: DataFrame) -> DataFrame:
    return b.join(killed.select(F.col("prey_id").alias("agent_id")), "agent_id", "left_anti")


def gains(a: DataFrame, killed: DataFrame, acc: str, amount: float) -> DataFrame:
    """Add amount per kill to the accumulator; kills are counted before the join."""
    n = killed.groupBy(F.col("predator_id").alias("agent_id")).agg(F.count(F.lit(1)).alias("__n"))
    return (a.join(n, "agent_id", "left")
            .withColumn(acc, F.col(acc) + F.coalesce("__n", F.lit(0)) * F.lit(float(amount))).drop("__n"))


def encounter_totals(a: DataFrame, b: DataFrame, p: float, seed: int, predation: bool = True, keys=("cell",),
                     key: Key = "agent_id") -> DataFrame:
    """(cell, pairs, encounters, kills): hits over all pairs of a cell, and prey killed.

    Given the first hit of every prey, the hits that remain in a cell are one binomial draw over the
    pairs not yet tried, so a cell costs a few table lookups. Without predation no prey dies.
    """
    n = cell_counts(a, b, keys)
    drawn = (b.filter("alive").select(*keys, first_hit(hash_u(seed, "encounter", key), p).alias("__hit"))
             .groupBy(*keys, "__hit").agg(F.count(F.lit(1)).alias("__k")).join(n, list(keys)))
    hit = F.col("__hit").isNotNull() & (F.col("__hit") < F.col("n_a"))
    per = drawn.groupBy(*keys).agg(
        F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"),
        F.sum(F.when(hit, F.col("__k")).otherwise(0)).alias("kills"),
        F.sum(F.when(hit, F.col("__k") * (F.col("n_a") - 1 - F.col("__hit"))).otherwise(0)).alias("open"))
    extra = binomial(per.select(*keys, "open"), list(keys), "open", p, seed, "encounter.rest")
    out = matched(per, extra, list(keys), "left")
    return out.select(*keys, (F.col("n_a") * F.col("n_b")).alias("pairs"), (F.col("kills") + F.coalesce("hits", F.lit(0))).alias("encounters"),
                      (F.col("kills") if predation else F.lit(0).cast("long")).alias("kills"))


def binomial_table(trials: int, p: float, reach: float = 14.0) -> tuple[int, list[float]]:
    """(first, cumulative probabilities from first on) of the number of hits, `reach` standard deviations to both sides of the mean."""
    mean, sd = trials * p, math.sqrt(trials * p * (1 - p))
    low, high = max(0, math.floor(mean - reach * sd - reach)), min(trials, math.ceil(mean + reach * sd + reach))
    total, out = 0.0, []
    for k in range(low, high + 1):
        total += math.exp(math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(p) + (trials - k) * math.log1p(-p))
        out.append(total)
    return low, out[:-1]


def binomial(rows: DataFrame, keys: list[str], trials: str, p: float, seed: int, stream: str) -> DataFrame:
    """(keys..., hits): a keyed draw of the number of hits in `trials` trials of probability p; without trials no row.

    Trials are split into parts of 2^TRIAL_BITS and one part for each lower binary digit, so that a few small tables of cumulative probabilities
    serve any number. Each part is drawn by inverse CDF with its own key: a binary search in its table.
    """
    count = F.col(trials)
    if not 0.0 < p < 1.0:
        return rows.filter(count > 0).groupBy(*keys).agg(F.sum(count if p >= 1.0 else F.lit(0).cast("long")).alias("hits"))
    tables = [binomial_table(1 << k, p) for k in range(TRIAL_BITS + 1)]
    size = max(len(t) for _, t in tables)
    digits = F.array_compact(F.array(*[F.when(count.bitwiseAND(F.lit(1 << k).cast("long")) > 0, F.struct(F.lit(k).alias("bits"), F.lit(0).cast("long").alias("part")))
                                       for k in range(TRIAL_BITS)]))
    whole = F.shiftright(trials, TRIAL_BITS)
    blocks = F.when(whole > 0, F.transform(F.sequence(F.lit(1).cast("long"), whole), lambda i: F.struct(F.lit(TRIAL_BITS).alias("bits"), i.alias("part")))).otherwise(F.slice(digits, 1, 0))
    parts = rows.filter(count > 0).select(*keys, F.explode(F.concat(digits, blocks)).alias("d")).select(*keys, "d.bits", "d.part")
    drawn = parts.withColumn("u", hash_u(seed, stream, *keys, "bits", "part"))
    first = F.element_at(F.lit([low for low, _ in tables]), F.col("bits") + 1)
    chosen = F.element_at(F.array(*[F.lit(t) if t else F.array().cast("array<double>") for _, t in tables]), F.col("bits") + 1)
    return drawn.withColumn("hits", first + place(F.col("u"), chosen, size)).groupBy(*keys).agg(F.sum("hits").alias("hits"))
