"""Categorical traits: binning, genetic maps, Markov transitions, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.rand import Key, count_le_row, cumulative, draw
from driftgrid.operators.filters import resolve_category
from driftgrid.plans.ordered import previous


def bin_trait(value, thresholds) -> Column:
    """Number of thresholds <= value; NaN falls in the last bin."""
    v = F.col(value) if isinstance(value, str) else value
    total = F.lit(0)
    for b in thresholds:
        total = total + F.when(v >= F.lit(float(b)), 1).otherwise(0)
    return total.cast("int")


def genetic_trait(df: DataFrame, trait: str, a0: str, a1: str, phenotype) -> DataFrame:
    """Category phenotype[a0][a1] from a small matrix, as a literal two-level array lookup."""
    rows = F.array(*[F.array(*[F.lit(int(x)) for x in r]) for r in phenotype])
    return df.withColumn(trait, F.get(F.get(rows, F.col(a0)), F.col(a1)))


def polygenic_trait(genotypes: DataFrame, weights: dict, thresholds) -> DataFrame:
    """(agent_id, score, category): weighted allele sum over named loci, then binned."""
    w = F.create_map(*[x for n, v in weights.items() for x in (F.lit(n), F.lit(float(v)))])
    score = (genotypes.filter(F.col("locus").isin(list(weights))).groupBy("agent_id")
             .agg(F.sum(F.element_at(w, F.col("locus")) * (F.col("a0") + F.col("a1"))).alias("score")))
    return score.withColumn("category", bin_trait("score", thresholds))


def category_name(trait: str, labels) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), F.col(trait))


def markov_transition(df: DataFrame, trait: str, matrix, seed: int, key: Key = "agent_id", mask=None) -> DataFrame:
    """Redraw the category from the matrix row of the current one; a category without a row stays.

    The matrix is a bounded parameter, so its cumulative rows travel as literals.
    """
    drawn = count_le_row(F.col("__u"), [cumulative(r)[:-1] for r in matrix], F.col(trait)).cast("int")
    known = (F.col(trait) >= 0) & (F.col(trait) < len(matrix))
    mask = F.lit(True) if mask is None else mask
    out = draw(df, "__u", seed, "transition", key)
    return out.withColumn(trait, F.when(mask & known, drawn).otherwise(F.col(trait))).drop("__u")


def transition_counts(df: DataFrame, trait: str, key: str = "agent_id", t: str = "time") -> DataFrame:
    """(t, from, to, n) over consecutive observations of an individual."""
    seen = previous(df.select(key, t, trait), [key], t, {"from": trait})
    return (seen.filter(F.col("from").isNotNull()).groupBy(t, "from", F.col(trait).alias("to"))
            .agg(F.count(F.lit(1)).alias("n")))


def set_traits(df: DataFrame, definitions: dict, values: dict, mask=None) -> DataFrame:
    """Write literal categories ({trait: label or index}) on the masked rows."""
    mask = F.lit(True) if mask is None else mask
    return df.withColumns({t: F.when(mask, F.lit(resolve_category(definitions[t], v))).otherwise(F.col(t))
                           for t, v in values.items()})
