"""Lookups of fields, zones and parameters by cell and time.

Lookups are left equi joins of many rows to one; the planner broadcasts the lookup side only when
its measured size is under the broadcast threshold, and splits skewed cells otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.rand import Key, hash_u


def sample_field(rows: DataFrame, field: DataFrame, values, keys=("cell",)) -> DataFrame:
    """Field values at each row; off the mesh (-1) or unknown cells give null."""
    f = field.withColumnRenamed("cell_id", "cell").select(*keys, *values)
    return rows.join(f, list(keys), "left")


def align_time_wrap(step: Column, n_time: int) -> Column:
    return F.pmod(step, F.lit(n_time)).cast("int")


def align_time_clamp(step: Column, n_time: int) -> Column:
    """Index into a coarser series: as is while it fits, else scaled down, never past the end."""
    n = F.lit(n_time)
    ratio = F.greatest(F.lit(1), F.floor((step + 1) / n))
    idx = F.when(step < n, step).otherwise(F.floor(step / ratio))
    return F.greatest(F.lit(0), F.least(idx, n - 1)).cast("int")


def zone_field(cells: DataFrame, zone_table: DataFrame, t: int | Column, n_steps: int, value: str) -> DataFrame:
    """Zone value at each cell for step t mod n_steps; raw zone numbers count from one, 0 joins zone 0."""
    step = F.pmod(t if isinstance(t, Column) else F.lit(t), F.lit(n_steps)).cast("int")
    keyed = cells.withColumns({"zone": F.greatest(F.col("zone_raw") - 1, F.lit(0)).cast("int"), "t": step})
    return keyed.join(zone_table.select("zone", "t", value), ["zone", "t"], "left").select("cell_id", "zone", "t", value)


def missing_cells(cells: DataFrame, forcing: DataFrame) -> DataFrame:
    return cells.select("cell_id").join(forcing.select("cell_id"), "cell_id", "left_anti")


def align_or_fail(cells: DataFrame, forcing: DataFrame) -> DataFrame:
    """forcing restricted to the cells; raises when a cell has none."""
    gone = missing_cells(cells, forcing).agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("first")).first()
    if gone["n"]:
        raise ValueError(f"{gone['n']} cell(s) not in the forcing; first missing id: {gone['first']}")
    return forcing.join(cells.select("cell_id"), "cell_id", "left_semi")


def origin_dispatch(rows: DataFrame, table_a: dict, table_b: dict | None, name: str) -> DataFrame:
    """Value by behaviour from the table of the row's origin (1 = b); a fills what b lacks."""
    def lut(t):
        return F.create_map(*[x for k, v in t.items() for x in (F.lit(k), F.lit(float(v)))])
    base = F.element_at(lut(table_a), F.col("behavior"))
    if table_b is None:
        return rows.withColumn(name, base)
    over = F.element_at(lut(table_b), F.col("behavior"))
    return rows.withColumn(name, F.when(F.col("origin") == 1, F.coalesce(over, base)).otherwise(base))


def switch_population(src: DataFrame, dst: DataFrame, p: float, seed: int, next_id: Column | None = None, key: Key = "agent_id"):
    """Move a Bernoulli subset of living rows to dst. Returns (src, dst).

    Moved rows keep position, natal region, exit branch, origin, sea age and sticky flags; the rest
    is reset. New ids continue after the target's maximum, by distributed rank.
    """
    from driftgrid.operators.sets import add_agents
    from driftgrid.plans.ordered import ranked
    goes = F.col("alive") & (hash_u(seed, "switch", key) < p)
    kept = [c for c in ("cell", "natal", "exit_branch", "origin", "sea_age", "been_to_sea", "arrived") if c in src.columns]
    movers = ranked(src.filter(goes).select("agent_id", *kept), [], "agent_id", "__rank")
    if next_id is None:
        next_id = dst.agg(F.coalesce(F.max("agent_id") + 1, F.lit(0))).scalar()
    new = movers.withColumn("agent_id", next_id + F.col("__rank") - 1).select("agent_id", *kept)
    return src.withColumn("alive", F.col("alive") & ~goes), add_agents(dst, new)


def barrier_classes(edges: DataFrame, class_map: dict) -> DataFrame:
    """(src, dst, p_mort, p_defl, p_trans) in both directions; an unknown class is impassable.

    class_map = {class: ((mort, defl, trans) forward, (…) reverse)} is a bounded parameter.
    """
    def outcome(p):
        return F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(p, ("p_mort", "p_defl", "p_trans"))])
    def pick(side):
        col = None
        for name, sides in class_map.items():
            hit = F.col("class_name") == name
            col = F.when(hit, outcome(sides[side])) if col is None else col.when(hit, outcome(sides[side]))
        wall = outcome((0.0, 1.0, 0.0))
        return wall if col is None else col.otherwise(wall)
    both = F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), pick(0).alias("o")),
                   F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), pick(1).alias("o")))
    return edges.select(F.explode(both).alias("e")).select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"), "e.o.*")


def row_neighbours(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell_id, neighbour, slot) for every edge leaving a known cell."""
    return cells.select("cell_id").join(
        edges.select(F.col("src").alias("cell_id"), F.col("dst").alias("neighbour"), "slot"), "cell_id")


def edge_length_hops(speed: float, seconds: float, edge_m: Column, most: int) -> Column:
    """Cell hops per step: swim distance over edge length, rounded half-even, within 1..most."""
    hops = F.bround(F.lit(float(speed * seconds)) / F.greatest(edge_m, F.lit(1.0)), 0)
    return F.least(F.greatest(hops, F.lit(1.0)), F.lit(float(most))).cast("int")
