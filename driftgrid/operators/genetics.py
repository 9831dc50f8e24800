"""Long genotype tables: (agent_id, locus_idx, locus, n_alleles, position_cm, a0, a1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.domain import haldane
from driftgrid.functions.rand import count_le_row, cumulative, hash_u


def random_genotypes(ids: DataFrame, loci, seed: int) -> DataFrame:
    """Uniform alleles for every id and locus; loci = [(name, n_alleles, position_cm)]."""
    dim = F.array(*[F.struct(F.lit(i).alias("locus_idx"), F.lit(n).alias("locus"), F.lit(k).alias("n_alleles"), F.lit(float(cm)).alias("position_cm"))
                    for i, (n, k, cm) in enumerate(loci)])
    def allele(c):
        return F.floor(hash_u(seed, c, "agent_id", "locus_idx") * F.col("n_alleles")).cast("int")
    return (ids.select("agent_id", F.explode(dim).alias("l")).select("agent_id", "l.*")
            .withColumns({"a0": allele("allele0"), "a1": allele("allele1")}))


def locus(genotypes: DataFrame, name: str) -> DataFrame:
    return genotypes.filter(F.col("locus") == name).select("agent_id", "a0", "a1")


def gametes(children: DataFrame, genotypes: DataFrame, seed: int, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """One allele per locus from the parent: (child, locus_idx, allele).

    The first strand is a coin; each later locus switches with its map-distance probability. The
    window spans the loci of one child, a fixed small number.
    """
    g = children.select(child, parent).join(genotypes.withColumnRenamed("agent_id", parent), parent)
    w = Window.partitionBy(child, parent).orderBy("locus_idx")
    # Recombination between a locus and the one before it; distances are never negative.
    r = haldane(F.abs(F.col("position_cm") - F.lag("position_cm").over(w)))
    g = g.withColumn("__r", r)
    u = hash_u(seed, f"strand.{parent}", child, "locus_idx")
    flip = F.when(F.col("__r").isNull(), (u >= 0.5).cast("int")).otherwise((u < F.col("__r")).cast("int"))
    strand = F.sum(flip).over(w) % 2
    return g.select(child, "locus_idx", F.when(strand == 0, F.col("a0")).otherwise(F.col("a1")).alias("allele"))


def recombine(children: DataFrame, genotypes: DataFrame, seed: int) -> DataFrame:
    """children(child_id, parent1_id, parent2_id) -> (agent_id, locus_idx, a0, a1)."""
    one = gametes(children, genotypes, seed, "parent1_id").withColumnRenamed("allele", "a0")
    two = gametes(children, genotypes, seed, "parent2_id").withColumnRenamed("allele", "a1")
    return one.join(two, ["child_id", "locus_idx"]).select(F.col("child_id").alias("agent_id"), "locus_idx", "a0", "a1")


def mutate(genotypes: DataFrame, name: str, matrix, seed: int, mask=None) -> DataFrame:
    """Redraw both copies of a locus from their matrix rows; adds changed (0..2) per row."""
    rows = [cumulative(r)[:-1] for r in matrix]
    here = (F.col("locus") == name) & (F.lit(True) if mask is None else mask)
    def redraw(c):
        new = count_le_row(F.col(f"__u_{c}"), rows, F.col(c)).cast("int")
        return F.when(here & (F.col(c) < len(matrix)), new).otherwise(F.col(c))
    out = genotypes.withColumns({f"__u_{c}": hash_u(seed, f"mutate.{c}", "agent_id", "locus_idx") for c in ("a0", "a1")})
    out = out.withColumns({"__n0": redraw("a0"), "__n1": redraw("a1")})
    changed = (F.col("__n0") != F.col("a0")).cast("int") + (F.col("__n1") != F.col("a1")).cast("int")
    return (out.withColumn("changed", changed).withColumns({"a0": F.col("__n0"), "a1": F.col("__n1")})
            .drop("__n0", "__n1", "__u_a0", "__u_a1"))
