"""Moves to a neighbouring cell.

The neighbours of a cell are few (the grid degree), so they are packed once per cell into an array
ordered by slot. Individuals then join one row per cell and choose inside a projection: there is no
fan-out per individual and no regrouping, and a crowded cell is an ordinary skewed left join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.rand import Key, draw, hash_u
from driftgrid.plans.lineage import cut
from driftgrid.plans.skew import shuffled


def adjacency(cells: DataFrame, edges: DataFrame, attrs=()) -> DataFrame:
    """One row per cell: cell, own attributes as c_<attr>, and nbrs = array(slot, dst, attrs...).

    A cell has at most the grid's degree of neighbours (six on a hexagonal grid, a few dozen across
    levels); checks.degree finds edge tables that break this.
    """
    own = cells.select(F.col("cell_id").alias("cell"), *[F.col(a).alias(f"c_{a}") for a in attrs])
    tagged = edges.join(shuffled(cells.select(F.col("cell_id").alias("dst"), *attrs)), "dst") if attrs else edges
    packed = tagged.groupBy(F.col("src").alias("cell")).agg(
        F.sort_array(F.collect_list(F.struct("slot", "dst", *attrs))).alias("nbrs"))   # at most the degree
    kind = dict(packed.dtypes)["nbrs"]
    return own.join(shuffled(packed), "cell", "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast(kind)))


def _best(nbrs: Column, value, largest: bool, keep=None) -> Column:
    """struct(v, s, dst) of the best neighbour, the lowest slot on ties; null when none is left."""
    def score(n):
        v = value(n)
        return F.struct((v if largest else -v).alias("v"), (-n["slot"]).alias("s"), n["dst"].alias("dst"))
    usable = F.filter(nbrs, lambda n: ~F.isnan(value(n)) & (keep(n) if keep is not None else F.lit(True)))
    return F.array_max(F.transform(usable, score))


def best_neighbour(agents: DataFrame, adj: DataFrame, field: str, ascending: bool = True, must_improve: bool = True) -> DataFrame:
    """Add new_cell: the neighbour with the largest (or smallest) field.

    must_improve stays put unless the neighbour is strictly better than the current cell.
    """
    out = agents.join(shuffled(adj), "cell", "left")
    best = _best(F.col("nbrs"), lambda n: n[field], ascending)
    new = best["dst"]
    if must_improve:
        here = F.col(f"c_{field}") if ascending else -F.col(f"c_{field}")
        new = F.when(best["v"] > here, new)
    return out.select(*agents.columns, F.coalesce(new, F.col("cell")).alias("new_cell"))


def toward_target(agents: DataFrame, adj: DataFrame, cells: DataFrame) -> DataFrame:
    """Neighbour nearest to the row's target cell when nearer than now; a negative target stays."""
    goal = cells.select(F.col("cell_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    out = agents.join(shuffled(adj), "cell", "left").join(shuffled(goal), "target", "left")
    def d2(x, y):
        return F.pow(x - F.col("tx"), F.lit(2.0)) + F.pow(y - F.col("ty"), F.lit(2.0))
    best = _best(F.col("nbrs"), lambda n: d2(n["x"], n["y"]), largest=False)
    nearer = (F.col("target") >= 0) & (-best["v"] < d2(F.col("c_x"), F.col("c_y")))
    return out.select(*agents.columns, F.coalesce(F.when(nearer, best["dst"]), F.col("cell")).alias("new_cell"))


def pick_affinity(agents: DataFrame, adj: DataFrame, field: str, lo: Column, hi: Column, strategy: str = "better") -> DataFrame:
    """Best neighbour whose field differs from here by lo..hi; none gives -1 and error 1."""
    out = agents.join(shuffled(adj), "cell", "left")
    here = F.col(f"c_{field}")
    def inside(n):
        gap = F.abs(n[field] - here)
        ok = (gap >= lo) & (gap <= hi)
        return ok & (n[field] > here) if strategy == "better" else ok
    target = F.coalesce(_best(F.col("nbrs"), lambda n: n[field], True, inside)["dst"], F.lit(-1))
    return out.select(*agents.columns, target.alias("target"), F.when(target < 0, 1.0).otherwise(0.0).alias("error"))


def cold_neighbour(agents: DataFrame, adj: DataFrame, temperature: str, threshold: float) -> DataFrame:
    """Stay when cold enough, else the coldest neighbour even if it is warmer."""
    out = agents.join(shuffled(adj), "cell", "left")
    best = _best(F.col("nbrs"), lambda n: n[temperature], largest=False)
    new = F.when(F.col(f"c_{temperature}") < threshold, F.col("cell")).otherwise(best["dst"])
    return out.select(*agents.columns, F.coalesce(new, F.col("cell")).alias("new_cell"))


def pick_slot(nbrs: Column, u: Column) -> Column:
    """Neighbour number floor(u x count), capped at the last; null without neighbours."""
    n = F.size(nbrs)
    i = F.least(F.floor(u * n).cast("int"), n - 1)
    return F.when(n > 0, F.get(nbrs, i)["dst"])


def random_neighbour(agents: DataFrame, adj: DataFrame, seed: int, stream: str = "hop", key: Key = "agent_id") -> DataFrame:
    out = agents.join(shuffled(adj), "cell", "left")
    new = pick_slot(F.col("nbrs"), hash_u(seed, stream, key))
    return out.select(*agents.columns, F.coalesce(new, F.col("cell")).alias("new_cell"))


def flow_neighbour(agents: DataFrame, adj: DataFrame, seed: int, scale_x: float = 1.0, scale_y: float = 1.0,
                   slowest: float = 0.01, key: Key = "agent_id") -> DataFrame:
    """Drift to the neighbour most aligned with the current, with probability min(5 x speed, 0.8).

    adj carries x, y, u and v; scale_x and scale_y turn centroid differences into metres.
    """
    out = agents.join(shuffled(adj), "cell", "left")
    u, v = F.col("c_u"), F.col("c_v")
    speed = F.sqrt(u * u + v * v)
    norm = speed + F.lit(1e-12)
    def along(n):
        dx, dy = (n["x"] - F.col("c_x")) * F.lit(float(scale_x)), (n["y"] - F.col("c_y")) * F.lit(float(scale_y))
        d = F.sqrt(dx * dx + dy * dy) + F.lit(1e-12)
        # Alignment is compared at 12 digits so that symmetric directions tie and the slot decides.
        return F.round((dx / d) * (u / norm) + (dy / d) * (v / norm), 12)
    best = _best(F.col("nbrs"), along, True)
    drifts = (speed >= slowest) & (hash_u(seed, "drift", key) < F.least(speed * 5.0, F.lit(0.8)))
    return out.select(*agents.columns, F.coalesce(F.when(drifts, best["dst"]), F.col("cell")).alias("new_cell"))


def barrier_outcome(moves: DataFrame, edge_probs: DataFrame, seed: int, key: Key = "agent_id") -> DataFrame:
    """Resolve moves(cell -> new_cell) against directed edge probabilities.

    Adds outcome (passed, deflected, died) and final_cell. No move, or an edge without
    probabilities, passes.
    """
    p = edge_probs.select(F.col("src").alias("cell"), F.col("dst").alias("new_cell"), "p_mort", "p_defl")
    out = moves.join(shuffled(p), ["cell", "new_cell"], "left")
    out = draw(out, "__u", seed, "barrier", key)
    moved, u = F.col("cell") != F.col("new_cell"), F.col("__u")
    state = (F.when(moved & (u < F.col("p_mort")), F.lit("died"))
             .when(moved & (u < F.col("p_mort") + F.col("p_defl")), F.lit("deflected")).otherwise(F.lit("passed")))
    out = out.withColumn("outcome", state)
    return out.select(*moves.columns, "outcome", F.when(F.col("outcome") == "deflected", F.col("cell"))
                      .otherwise(F.col("new_cell")).alias("final_cell"))


CUT_HOPS = 4    # hops between lineage cuts


def bounded_walk(agents: DataFrame, adj: DataFrame, field: str, mode: str, hops: int, seed: int,
                 ascending: bool = True, threshold: float | None = None, halt: float | None = None,
                 key: str = "agent_id") -> DataFrame:
    """Up to hops moves with a time budget of 1; each costs 1 / c_n_micro of the cell left.

    mode: directed (even hops to the best neighbour, odd ones random), random, cold, or gradient
    (strictly better neighbour; hops count as distance up to halt instead of a budget).
    Adds walk_cell, budget and distance. The number of hops is a small parameter.
    """
    cur = agents.select(key, F.col("cell"), F.lit(1.0).alias("__budget"), F.lit(0.0).alias("__dist"))
    for h in range(hops):
        row = cur.join(shuffled(adj), "cell", "left")
        nbrs = F.col("nbrs")
        if mode == "random" or (mode == "directed" and h % 2 == 1):
            new = pick_slot(nbrs, hash_u(seed, f"walk.{h}", key))
        elif mode == "cold":
            new = F.when(F.col(f"c_{field}") >= threshold, _best(nbrs, lambda n: n[field], False)["dst"])
        else:
            best = _best(nbrs, lambda n: n[field], ascending)
            here = F.col(f"c_{field}") if ascending else -F.col(f"c_{field}")
            new = F.when(best["v"] > here, best["dst"]) if mode == "gradient" else best["dst"]
        if mode == "gradient":
            go = new.isNotNull() & (F.lit(True) if not halt else F.col("__dist") < halt)
            cost = F.lit(0.0)
        else:
            go = new.isNotNull() & (F.col("__budget") > 0)
            cost = F.lit(1.0) / F.col("c_n_micro")
        cur = row.select(key, F.when(go, new).otherwise(F.col("cell")).alias("cell"),
                         F.when(go, F.col("__budget") - cost).otherwise(F.col("__budget")).alias("__budget"),
                         F.when(go, F.col("__dist") + 1.0).otherwise(F.col("__dist")).alias("__dist"))
        if h % CUT_HOPS == CUT_HOPS - 1 and h + 1 < hops:
            cur = cut(cur)
    return agents.join(cur.select(key, F.col("cell").alias("walk_cell"), F.col("__budget").alias("budget"),
                                  F.col("__dist").alias("distance")), key)
