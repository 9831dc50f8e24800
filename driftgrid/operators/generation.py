"""New rows and random subsets, all driven by keyed uniforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.domain import daily_to_hourly
from driftgrid.functions.rand import Key, categorical, count_le, draw, hash_u, normal, poisson
from driftgrid.operators.filters import active_mask
from driftgrid.plans.lineage import cut
from driftgrid.plans.ordered import ranked, running
from driftgrid.plans.skew import shuffled


def bernoulli(df: DataFrame, name: str, p, seed: int, stream: str, key: Key = "agent_id") -> DataFrame:
    return df.withColumn(name, hash_u(seed, stream, key) < (p if isinstance(p, Column) else F.lit(float(p))))


def survival_deaths(df: DataFrame, region: str, daily: dict, default: float, seed: int, key: Key = "agent_id") -> DataFrame:
    """died where the draw exceeds the hourly survival of the row's region."""
    rate = F.coalesce(F.element_at(F.create_map(*[x for k, v in daily.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(region)),
                      F.lit(float(default)))
    return df.withColumn("died", hash_u(seed, "predation", key) > daily_to_hourly(rate))


def entry_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_id, entry): the lowest cell with a water neighbour, else the lowest cell."""
    linked = edges.select(F.col("src").alias("cell_id")).distinct().withColumn("__wet", F.lit(0))
    return (cells.filter("region_id >= 0").select("cell_id", "region_id").join(linked, "cell_id", "left")
            .groupBy("region_id").agg(F.min(F.struct(F.coalesce("__wet", F.lit(1)).alias("dry"), "cell_id")).alias("m"))
            .select("region_id", F.col("m.cell_id").alias("entry")))


def entry_cell(cells: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Entry cell per wanted region, -1 when it has no cells."""
    return (regions.select("region_id").join(entry_cells(cells, edges), "region_id", "left")
            .fillna(-1, ["entry"]))


# --- reproduction -----------------------------------------------------------------------------

def spawners(parents: DataFrame, clutch_mean: float, min_group: int, skip_p: float, seed: int, reared: int = 1) -> DataFrame:
    """Parents of a large enough group with their Poisson clutch size."""
    able = parents.filter(active_mask() & (F.col("group_id") >= 0))
    if min_group > 1:
        big = able.groupBy("group_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_group)
        able = able.join(big.select("group_id"), "group_id", "left_semi")
    skip = (F.col("origin") == reared) & (hash_u(seed, "skip", "agent_id") < skip_p)
    able = draw(able.filter(~skip), "__u", seed, "clutch", "agent_id")
    return able.withColumn("clutch", poisson(F.col("__u"), clutch_mean)).drop("__u")


def reproduce(parents: DataFrame, clutch_mean: float = 4.0, min_group: int = 1, skip_p: float = 0.0, seed: int = 0,
              mass_mean: float = 100.0, mass_sd: float = 20.0) -> DataFrame:
    """One row per child: parent_id, child_no, cell, mass; wild, ungrouped."""
    born = (spawners(parents, clutch_mean, min_group, skip_p, seed).filter("clutch > 0")
            .select(F.col("agent_id").alias("parent_id"), "cell", F.explode(F.sequence(F.lit(1), F.col("clutch"))).alias("child_no")))
    mass = F.lit(mass_mean) + F.lit(mass_sd) * normal(seed, "child.mass", "parent_id", "child_no")
    return born.withColumns({"mass_g": F.least(F.greatest(mass, F.lit(0.5 * mass_mean)), F.lit(1.5 * mass_mean)),
                             "origin": F.lit(0), "group_id": F.lit(-1)})


def pick_mate(parents: DataFrame, members: DataFrame, seed: int) -> DataFrame:
    """Add mate_id: a random other living member of the parent's group, or the parent itself.

    Members get a distributed rank in their group; the drawn rank joins back on (group, rank).
    """
    able = members.filter(F.col("alive") & (F.col("group_id") >= 0)).select("group_id", "agent_id")
    order = ranked(able, ["group_id"], "agent_id", "__r")
    sizes = able.groupBy("group_id").agg(F.count(F.lit(1)).alias("__k"))
    own = (parents.join(order, ["group_id", "agent_id"], "left").join(sizes, "group_id", "left")
           .withColumn("__others", F.coalesce("__k", F.lit(0)) - F.col("__r").isNotNull().cast("int")))
    j = F.floor(hash_u(seed, "mate", "agent_id") * F.col("__others")) + 1
    pick = F.when(F.col("__others") > 0, F.when(F.col("__r").isNotNull() & (j >= F.col("__r")), j + 1).otherwise(j))
    mates = order.select("group_id", F.col("__r").alias("__pick"), F.col("agent_id").alias("mate_id"))
    out = own.withColumn("__pick", pick).join(mates, ["group_id", "__pick"], "left")
    return out.select(*parents.columns, F.coalesce("mate_id", F.col("agent_id")).alias("mate_id"))


# --- introduction -----------------------------------------------------------------------------

def weighted_cells(draws: DataFrame, cells: DataFrame, weight: str, seed: int, buckets: int | None = None) -> DataFrame:
    """One cell per draw(agent_id), with probability proportional to weight; -1 with no weight at all.

    The cumulative weight is a scan whose spans follow the cells' ids. Every cell owns an interval that begins where the one
    before it ends, exactly, and is listed in the buckets it overlaps, so a draw meets only the few cells of its
    bucket. The number of buckets follows the number of cells, and a heavy cell simply covers many buckets.
    """
    live = cells.filter(F.col(weight) > 0).select("cell_id", F.col(weight).cast("double").alias("__w"))
    sums = cut(running(live, [], "cell_id", {"__sum": ("sum", F.col("__w"))}, span=None))
    # Sums of neighbouring spans may differ in their last bit; the largest sum so far is where an interval begins.
    cum = running(sums, [], "cell_id", {"__before": ("max", F.col("__sum"))}, before=True, span=None)
    cum = cut(cum.select("cell_id", F.coalesce("__before", F.lit(0.0)).alias("__lo"), F.greatest("__before", "__sum").alias("__hi")))
    stats = cum.agg(F.count(F.lit(1)).alias("n"), F.max("__hi").alias("total")).first()
    if not stats["n"]:
        return draws.withColumn("cell", F.lit(-1).cast("long"))
    b = buckets or stats["n"]
    total = F.lit(float(stats["total"]))
    # Bounds stay in weight units, so a draw is compared with exact sums when weights are integers.
    last = F.lit(b - 1)
    per = cum.filter("__lo < __hi").select("cell_id", "__lo", "__hi", F.explode(F.sequence(
        F.least(F.floor(F.col("__lo") / total * b), last), F.least(F.floor(F.col("__hi") / total * b), last))).alias("__b"))
    u = hash_u(seed, "introduce", "agent_id")
    drawn = draws.withColumn("__u", u * total).withColumn("__b", F.least(F.floor(F.col("__u") / total * b), last))
    hit = drawn.join(per, "__b").filter((F.col("__lo") <= F.col("__u")) & (F.col("__u") < F.col("__hi")))
    return hit.select(*draws.columns, F.col("cell_id").alias("cell"))


def clipped_mass(seed: int, mean: float, sd: float, key: str = "agent_id") -> Column:
    mass = F.lit(mean) + F.lit(sd) * normal(seed, "mass", key)
    return F.least(F.greatest(mass, F.lit(0.5 * mean)), F.lit(1.5 * mean))


def introduce(draws: DataFrame, cells: DataFrame, layer: str, area: str | None, seed: int,
              mass_mean: float = 3500.0, mass_sd: float = 500.0) -> DataFrame:
    """Place every draw on a non-zero cell of the layer, area-weighted when an area is named."""
    w = F.when(F.col(layer) != 0, F.col(area) if area else F.lit(1.0)).otherwise(0.0)
    placed = weighted_cells(draws, cells.withColumn("__weight", w), "__weight", seed)
    return placed.withColumns({"cell": F.greatest(F.col("cell"), F.lit(0).cast("long")), "mass_g": clipped_mass(seed, mass_mean, mass_sd)})


def introduce_at(draws: DataFrame, positions, seed: int, mass_mean: float = 3500.0, mass_sd: float = 500.0) -> DataFrame:
    """Place draws on a short list of positions in turn."""
    pos = F.get(F.array(*[F.lit(int(p)).cast("long") for p in positions]), F.pmod(F.col("agent_id"), F.lit(len(positions))).cast("int"))
    return draws.withColumns({"cell": pos, "mass_g": clipped_mass(seed, mass_mean, mass_sd)})


def introduce_patch(cells: DataFrame, layer: str) -> DataFrame:
    """One new row on every non-zero cell."""
    return cells.filter(F.col(layer) != 0).select(F.col("cell_id").alias("cell"))


def sample_category(df: DataFrame, name: str, dist: dict, seed: int, stream: str, key: Key = "agent_id") -> DataFrame:
    """Draw from {value: probability}, values ascending."""
    values = sorted(dist)
    idx = categorical(F.col("__u"), [dist[v] for v in values])
    return draw(df, "__u", seed, stream, key).withColumn(name, F.get(F.array(*[F.lit(v) for v in values]), idx)).drop("__u")


def init_agents(ids: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """Mass N(3500, 500) clipped, spawn hour N(720, 168) truncated to at least 1, uniform water cell."""
    hour = F.greatest(F.lit(720.0) + F.lit(168.0) * normal(seed, "spawn", "agent_id"), F.lit(1.0)).cast("int")
    placed = weighted_cells(ids, cells.withColumn("__weight", F.col("water").cast("double")), "__weight", seed)
    return placed.withColumns({"mass_g": clipped_mass(seed, 3500.0, 500.0), "target_spawn_hour": hour,
                               "ed_kJ_g": F.lit(6.5), "alive": F.lit(True), "arrived": F.lit(False)})


# --- homing -----------------------------------------------------------------------------------

def homing_draw(touch: DataFrame, cells: DataFrame, edges: DataFrame, fractions: dict, precision: dict, seed: int) -> DataFrame:
    """First-touch tag with homing: touch(agent_id, natal, origin, region_id, cell).

    A native of a branch draws its own branch with precision[origin], else another one in proportion
    to fractions = {region: share}; if the draw differs from the touched branch it moves to the
    branch's entry cell. Others keep the touched branch. Adds exit_branch and new_cell.
    """
    branches = sorted(fractions)
    def row(natal, p):
        others = [b for b in branches if b != natal]
        total = sum(fractions[b] for b in others)
        order = [natal, *others]
        probs = [p] + [(1 - p) * fractions[b] / total for b in others]
        cum, acc = [], 0.0
        for x in probs[:-1]:
            acc += x
            cum.append(acc)
        return order, cum
    drawn = F.lit(None).cast("int")
    for natal in branches:
        for org, p in precision.items():
            order, cum = row(natal, p)
            pick = F.get(F.array(*[F.lit(b) for b in order]), count_le(F.col("__u"), cum))
            drawn = F.when((F.col("natal") == natal) & (F.col("origin") == org), pick).otherwise(drawn)
    tagged = draw(touch, "__u", seed, "homing", "agent_id").withColumn("exit_branch", F.coalesce(drawn, F.col("region_id")).cast("int"))
    entry = entry_cells(cells, edges).select(F.col("region_id").alias("exit_branch"), "entry")
    moved = F.when(F.col("exit_branch") != F.col("region_id"), F.col("entry")).otherwise(F.col("cell"))
    return tagged.join(entry, "exit_branch", "left").select(*touch.columns, "exit_branch", moved.alias("new_cell"))


# --- seeds ------------------------------------------------------------------------------------

def disperse_seeds(producers: DataFrame, adj: DataFrame, layer: DataFrame, resource: str, rate: float, radius: int,
                   threshold: float, seed: int) -> DataFrame:
    """Poisson seeds, radius rounds of a coin and a random hop, kept where the resource suffices."""
    from driftgrid.operators.neighbours import pick_slot
    seeds = (draw(producers, "__u", seed, "seeds", "agent_id").withColumn("__n", poisson(F.col("__u"), rate)).filter("__n > 0")
             .select(F.col("agent_id").alias("parent_id"), "cell", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("seed_no")))
    for h in range(radius):
        hop = pick_slot(F.col("nbrs"), hash_u(seed, f"seed.hop.{h}", "parent_id", "seed_no"))
        goes = hash_u(seed, f"seed.go.{h}", "parent_id", "seed_no") < 0.5
        seeds = seeds.join(shuffled(adj.select("cell", "nbrs")), "cell", "left").select(
            "parent_id", "seed_no", F.when(goes, F.coalesce(hop, F.col("cell"))).otherwise(F.col("cell")).alias("cell"))
    good = layer.filter(F.col(resource) >= threshold).select(F.col("cell_id").alias("cell"))
    return seeds.join(shuffled(good), "cell", "left_semi").withColumns({"mass_g": F.lit(1.0), "ed_kJ_g": F.lit(1.0)})


# --- parameters -------------------------------------------------------------------------------

def parameter_overrides(base: DataFrame, overrides: DataFrame, whole_groups=("distribution",)) -> DataFrame:
    """Merge long parameters(grp, name, value) with overrides.

    A group in whole_groups is replaced as a whole, any other parameter one by one. An override of
    an unknown name outside those groups is an error. Both tables are small configuration.
    """
    unknown = overrides.filter(~F.col("grp").isin(list(whole_groups))).join(base, ["grp", "name"], "left_anti")
    first = unknown.first()
    if first is not None:
        raise KeyError(f"unknown parameter {first['grp']}.{first['name']}")
    full = overrides.filter(F.col("grp").isin(list(whole_groups)))
    keep = base.join(full.select("grp").distinct(), "grp", "left_anti")
    merged = keep.join(overrides.select("grp", "name", F.col("value").alias("__o")), ["grp", "name"], "left")
    return merged.select("grp", "name", F.coalesce("__o", F.col("value")).alias("value")).unionByName(full.select("grp", "name", "value"))
