"""Population reports, per-cell tallies and summaries. All aggregates combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.rand import Key, hash_u
from driftgrid.plans.lineage import cut
from driftgrid.plans.ordered import previous
from driftgrid.plans.quantile import quantiles

ALIVE = "alive"


def count_when(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def mean_alive(col: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(ALIVE), F.col(col))), F.lit(0.0))


def step_summary(tracks: DataFrame, keys=("time",), n_behaviours: int = 5) -> DataFrame:
    """Alive and arrived counts, mean energy and mass of the alive, and behaviour counts."""
    return tracks.groupBy(*keys).agg(
        count_when(F.col(ALIVE)).alias("n_alive"), count_when(F.col("arrived")).alias("n_arrived"),
        mean_alive("ed_kJ_g").alias("mean_ed"), mean_alive("mass_g").alias("mean_mass"),
        *[count_when(F.col(ALIVE) & (F.col("behavior") == b)).alias(f"behavior_{b}") for b in range(n_behaviours)])


def productivity(counts: DataFrame, keys, t: str, n_alive: str) -> DataFrame:
    """Growth rate against the previous step, rounded half-even to 4 places."""
    out = previous(counts, keys, t, {"__before": n_alive})
    base = F.coalesce(F.col("__before"), F.col(n_alive))
    rate = F.when(base > 0, F.col(n_alive) / base).otherwise(F.lit(0.0))
    return out.withColumn("lambda", F.bround(rate, 4)).drop("__before")


def demographics(tracks: DataFrame, keys=("time",)) -> DataFrame:
    return tracks.groupBy(*keys).agg(
        count_when(F.col(ALIVE)).alias("n_alive"), count_when(~F.col(ALIVE)).alias("n_dead"),
        F.count(F.lit(1)).alias("n_total"), mean_alive("mass_g").alias("mean_mass"), mean_alive("ed_kJ_g").alias("mean_ed"))


def census(tracks: DataFrame, trait: str, labels, keys=("time",)) -> DataFrame:
    """One row per step and category, with zeros; the categories are literals, so no join."""
    per_step = tracks.groupBy(*keys).agg(
        count_when(F.col(ALIVE)).alias("n_alive"), count_when(~F.col(ALIVE)).alias("n_dead"),
        F.count(F.lit(1)).alias("n_total"),
        F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("label"),
                           count_when(F.col(ALIVE) & (F.col(trait) == i)).alias("n")) for i, n in enumerate(labels)]).alias("__c"))
    return (per_step.withColumn("__c", F.explode("__c"))
            .select(*keys, "n_alive", "n_dead", "n_total", F.col("__c.label").alias("category"), F.col("__c.n").alias("n")))


def census_cube(tracks: DataFrame, traits) -> DataFrame:
    """Alive counts for every combination of the traits and their subtotals (null = all)."""
    return tracks.filter(ALIVE).cube(*traits).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def dispersal(tracks: DataFrame, centroids: DataFrame) -> DataFrame:
    """Mean, max and exact median displacement from the first position, per step."""
    xy = centroids.select(F.col("cell_id").alias("cell"), "x", "y")
    placed = tracks.select("time", "agent_id", "cell").join(xy, "cell")
    first = placed.groupBy("agent_id").agg(F.min_by(F.struct("x", "y"), "time").alias("o"))
    moved = cut(placed.join(first, "agent_id").select(
        "time", F.sqrt(F.pow(F.col("x") - F.col("o.x"), F.lit(2.0)) + F.pow(F.col("y") - F.col("o.y"), F.lit(2.0))).alias("d")))
    return quantiles(moved, ["time"], "d", {"median_displacement": 0.5},
                     also={"mean_displacement": F.avg("d"), "max_displacement": F.max("d")})


def genetic_report(genotypes: DataFrame, locus: str, n_alleles: int) -> DataFrame:
    """Head count, heterozygosity and allele frequencies of one locus, zeros included."""
    g = genotypes.filter(F.col("locus") == locus)
    copies = [(count_when(F.col("a0") == i) + count_when(F.col("a1") == i)) for i in range(n_alleles)]
    return g.agg(F.count(F.lit(1)).alias("n_agents"),
                 F.bround(F.avg((F.col("a0") != F.col("a1")).cast("double")), 4).alias("heterozygosity"),
                 *[F.bround(c / (F.lit(2.0) * F.count(F.lit(1))), 4).alias(f"freq_allele_{i}") for i, c in enumerate(copies)]
                 ).filter("n_agents > 0")


def homozygosity(genotypes: DataFrame, locus: str | None = None) -> DataFrame:
    g = genotypes if locus is None else genotypes.filter(F.col("locus") == locus)
    return g.groupBy("agent_id").agg(F.avg((F.col("a0") == F.col("a1")).cast("double")).alias("homozygosity"))


# --- per-cell tallies -------------------------------------------------------------------------

def zero_fill(cells: DataFrame, tally: DataFrame, value: str) -> DataFrame:
    return cells.select("cell_id").join(tally, "cell_id", "left").fillna(0, [value])


def occupancy(tracks: DataFrame, cells: DataFrame) -> DataFrame:
    """Number of steps a cell held at least one living individual."""
    held = tracks.filter(ALIVE).select(F.col("cell").alias("cell_id"), "time").distinct()
    return zero_fill(cells, held.groupBy("cell_id").agg(F.count(F.lit(1)).alias("steps")), "steps")


def density(tracks: DataFrame, cells: DataFrame) -> DataFrame:
    n = tracks.filter(ALIVE).groupBy(F.col("cell").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))
    return zero_fill(cells, n, "n")


def density_by_step(tracks: DataFrame) -> DataFrame:
    return tracks.filter(ALIVE).groupBy("time", F.col("cell").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))


def flux(tracks: DataFrame, cells: DataFrame) -> DataFrame:
    """Arrivals minus departures per cell over living movers."""
    steps = previous(tracks.select("agent_id", "time", "cell", ALIVE), ["agent_id"], "time", {"old": "cell"})
    moved = steps.filter(F.col(ALIVE) & F.col("old").isNotNull() & (F.col("old") != F.col("cell")))
    ends = moved.select(F.explode(F.array(F.struct(F.col("cell").alias("cell_id"), F.lit(1).alias("d")),
                                          F.struct(F.col("old").alias("cell_id"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    return zero_fill(cells, ends.groupBy("cell_id").agg(F.sum("d").alias("net")), "net")


def barrier_tally(events: DataFrame, per_step_distinct: bool = False) -> DataFrame:
    """Deaths per cell; with per_step_distinct several deaths in one step count once."""
    died = events.filter("died")
    if per_step_distinct:
        died = died.select("cell_id", "time").distinct()
    return died.groupBy("cell_id").agg(F.count(F.lit(1)).alias("deaths"))


def range_summary(ranges: DataFrame) -> DataFrame:
    sizes = ranges.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_owners"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_cells"),
                     F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_size"), F.coalesce(F.max("n"), F.lit(0)).alias("max_size"))


def region_thresholds(cells: DataFrame, q: float = 0.75, dist: str = "dist") -> DataFrame:
    """Quantile of a distance over the water cells of each region; a region without any gives null."""
    regions = cells.filter("region_id >= 0").select("region_id").distinct()
    usable = cells.filter((F.col("region_id") >= 0) & F.col("water") & ~F.isnan(dist) & (F.abs(dist) < float("inf")))
    return regions.join(quantiles(usable, ["region_id"], dist, {"threshold": q}), "region_id", "left")


def density_survival(df: DataFrame, rates: dict, trait: str | None, labels=(), scale: float | None = None,
                     seed: int = 0, key: Key = "agent_id") -> DataFrame:
    """Add died: rate of the category, raised by local crowding, against a keyed draw.

    Cell head counts are reduced before they are joined back.
    """
    if trait is None:
        rate = F.lit(float(rates.get("default", 0.0)))
    else:
        rate = F.coalesce(F.get(F.array(*[F.lit(float(rates.get(n, 0.0))) for n in labels]), F.col(trait)), F.lit(0.0))
    out = df
    if scale is not None and trait is not None:
        heads = df.groupBy("cell").agg(F.count(F.lit(1)).alias("__heads"))
        out = out.join(heads, "cell", "left")
        rate = F.least(rate * (F.lit(1.0) + F.lit(float(scale)) * F.greatest(F.col("__heads") - F.lit(1.0), F.lit(0.0))), F.lit(1.0))
    return out.withColumn("died", hash_u(seed, "survival", key) < rate).select(*df.columns, "died")


def cell_diagnostics(cells: DataFrame, edges: DataFrame, names) -> DataFrame:
    from driftgrid.operators.filters import region_label
    lv = cells.select("cell_id", "level")
    deg = (edges.join(lv.select(F.col("cell_id").alias("src"), F.col("level").alias("ls")), "src")
           .join(lv.select(F.col("cell_id").alias("dst"), F.col("level").alias("ld")), "dst")
           .groupBy(F.col("src").alias("cell_id"))
           .agg(F.count(F.lit(1)).alias("degree"), count_when(F.col("ls") == F.col("ld")).alias("same_level"),
                count_when(F.col("ls") != F.col("ld")).alias("cross_level")))
    return (cells.join(deg, "cell_id", "left").fillna(0, ["degree", "same_level", "cross_level"])
            .select("cell_id", region_label(names).alias("region"), "level", "area", "depth", "degree", "same_level", "cross_level"))


def cross_region_links(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed links per unordered pair of different regions."""
    r = cells.filter("region_id >= 0").select("cell_id", "region_id")
    return (edges.join(r.select(F.col("cell_id").alias("src"), F.col("region_id").alias("ra")), "src")
            .join(r.select(F.col("cell_id").alias("dst"), F.col("region_id").alias("rb")), "dst")
            .filter(F.col("ra") != F.col("rb"))
            .groupBy(F.least("ra", "rb").alias("region_a"), F.greatest("ra", "rb").alias("region_b"))
            .agg(F.count(F.lit(1)).alias("links")))


def ensemble_summary(runs: DataFrame, value: str = "size") -> DataFrame:
    """Mean, population sd, min, median and max over the replicates of each step."""
    kind = runs.schema[value].dataType
    out = quantiles(runs.withColumn(value, F.col(value).cast("double")), ["step"], value, {"median": 0.5}, also={
        "n_runs": F.count(F.lit(1)), "mean": F.avg(value), "sd": F.stddev_pop(value), "low": F.min(value).cast(kind), "high": F.max(value).cast(kind)})
    return out.select("step", "n_runs", "mean", "sd", "low", "high", "median")


def final_state(runs: DataFrame) -> DataFrame:
    """Last step of each replicate."""
    return (runs.groupBy("run_id").agg(F.max_by(F.struct("step", "size", "n_arrived"), "step").alias("s"))
            .select("run_id", "s.*"))


def nan_fraction(field: DataFrame, value: str, keys=("t",), alarm: float = 0.5) -> DataFrame:
    return (field.groupBy(*keys).agg(F.avg(F.isnan(value).cast("double")).alias("nan_fraction"))
            .withColumn("alarm", F.col("nan_fraction") > alarm))


def field_range(field: DataFrame, columns) -> DataFrame:
    """(var, low, high, mean) over finite values, one aggregate pass for all variables."""
    def ok(c):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    one = field.agg(F.array(*[F.struct(F.lit(c).alias("var"), F.min(ok(c)).alias("low"), F.max(ok(c)).alias("high"),
                                       F.avg(ok(c)).alias("mean")) for c in columns]).alias("v"))
    return one.select(F.explode("v").alias("v")).select("v.*")


def agreement_share(flags: DataFrame, a: str, b: str) -> DataFrame:
    """Counts and shares inside a, b, both, either, neither."""
    n = F.count(F.lit(1))
    parts = {"in_a": F.col(a), "in_b": F.col(b), "both": F.col(a) & F.col(b), "either": F.col(a) | F.col(b),
             "neither": ~(F.col(a) | F.col(b))}
    return flags.agg(n.alias("n"), *[count_when(c).alias(k) for k, c in parts.items()],
                     *[(count_when(c) / n).alias(f"share_{k}") for k, c in parts.items()])
