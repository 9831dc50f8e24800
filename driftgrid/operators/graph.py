"""Graph operators on edge tables. Iterative ones keep a shrinking frontier and checkpoint it."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.domain import haversine
from driftgrid.functions.rand import Key, hash_u
from driftgrid.operators.grid import cube
from driftgrid.plans.lineage import cut
from driftgrid.plans.ordered import ranked
from driftgrid.plans.skew import shuffled, split_join
from driftgrid.plans.spans import place, table_bounds

MERGE_EVERY = 8         # rounds between merges of the improvement log
BLOCK_CELLS = 1 << 14   # cells that one task settles by itself


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "downstream") -> DataFrame:
    """(seed, node) for every node reachable from each seed; the seed itself only on a cycle.

    Path doubling: one table holds what lies exactly k steps from every node, k = 1, 2, 4, ..., and what a seed reaches
    in k steps, followed by exactly k more, is what it reaches in 2k. Rounds grow with the logarithm of the depth. In a
    stream network nearly every node has one successor, so the table of exact steps shrinks from round to round; nodes that
    very many seeds reach, such as an outlet, are dealt over tasks.
    """
    ends = ("src", "dst") if direction == "downstream" else ("dst", "src")
    step = cut(edges.select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("to")).distinct())
    found, reached = None, 0
    while not step.isEmpty():
        begin = seeds.select("seed", F.col("seed").alias("node")).distinct()
        have = begin if found is None else cut(begin.unionByName(found))
        on = split_join(have, step, "node", "inner").select("seed", F.col("to").alias("node"))
        found = cut((on if found is None else on.unionByName(found)).distinct())
        n = found.count()
        if n == reached:
            break
        reached = n
        twice = step.select(F.col("node").alias("from"), F.col("to").alias("node"))
        step = cut(split_join(twice, step, "node", "inner").select(F.col("from").alias("node"), "to").distinct())
    return found if found is not None else seeds.select("seed", F.col("seed").alias("node")).limit(0)


def headwaters(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments nothing flows into."""
    return segments.join(edges.select(F.col("dst").alias("segment_id")), "segment_id", "left_anti")


def outlets(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments that flow nowhere."""
    return segments.join(edges.select(F.col("src").alias("segment_id")), "segment_id", "left_anti")


def haversine_edges(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with weight in metres between centroids (lat, lon)."""
    c = cells.select("cell_id", "lat", "lon")
    return (edges.join(c.select(F.col("cell_id").alias("src"), F.col("lat").alias("la"), F.col("lon").alias("lo")), "src")
            .join(c.select(F.col("cell_id").alias("dst"), F.col("lat").alias("lb"), F.col("lon").alias("ob")), "dst")
            .select("src", "dst", haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("ob")).alias("weight")))


def _relaxed(edges: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """One block settled by its own edges: cells that got nearer (out false), and what reaches cells of other blocks (out true)."""
    known = {c: d for c, d, fresh in zip(state["cell_id"], state["dist"], state["fresh"], strict=True) if not fresh}
    heap = [(d, c) for c, d, fresh in zip(state["cell_id"], state["dist"], state["fresh"], strict=True) if fresh and d < known.get(c, math.inf)]
    block, edges = state["block"].iloc[0] if len(state) else -1, edges.sort_values("src")
    src, dst, w, home = (edges[c].to_numpy() for c in ("src", "dst", "w", "dst_block"))
    ids, first = np.unique(src, return_index=True)
    span = {c: (a, b) for c, a, b in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(src)], strict=True)}
    dst, w, home = dst.tolist(), w.tolist(), home.tolist()
    nearer, away = {}, {}
    for d, c in heap:
        nearer[c] = min(d, nearer.get(c, math.inf))
    heapq.heapify(heap)
    while heap:
        d, c = heapq.heappop(heap)
        if d > nearer[c]:
            continue
        for i in range(*span.get(c, (0, 0))):
            to, far = dst[i], d + w[i]
            if home[i] != block:
                if far < away.get(to, (math.inf,))[0]:
                    away[to] = (far, home[i])
            elif far < nearer.get(to, known.get(to, math.inf)):
                nearer[to] = far
                heapq.heappush(heap, (far, to))
    rows = [(c, d, block, False) for c, d in nearer.items()] + [(c, d, b, True) for c, (d, b) in away.items()]
    return pd.DataFrame(rows, columns=["cell_id", "dist", "block", "out"])


def distance_from_sources(cells: DataFrame, edges: DataFrame, sources: DataFrame, weight: str = "weight", block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(cell_id, dist) of the shortest path over water cells; unreached water is +Inf, land NaN.

    Block relaxation: cells are cut by id into blocks of about block_cells, and a block with news is settled inside one task.
    Only what crosses a border goes on to the next round, so rounds grow with the number of borders on a path and not with
    its cells. Ids of neighbouring cells are mostly close; where they are not, results are the same and rounds are more. A land
    neighbour is never entered. Weights are not negative.
    """
    wet = cut(cells.select("cell_id", "water"))
    bounds = table_bounds(wet, F.col("cell_id"), block_cells, 1 << 14)

    def with_blocks(rows: DataFrame, **names: str) -> DataFrame:
        """rows with the block of each named column; past a generator, so that no filter is inferred from the search."""
        cuts = F.lit(bounds) if bounds else F.array().cast("array<long>")
        found = F.array(F.struct(*[place(F.col(c), cuts, 1 << 14).alias(n) for n, c in names.items()]))
        return rows.select("*", F.explode(found).alias("__at")).select("*", "__at.*").drop("__at")

    e = cut(with_blocks(edges.select("src", "dst", F.col(weight).cast("double").alias("w")), block="src", dst_block="dst")
            .join(wet.filter("water").select(F.col("cell_id").alias("dst")), "dst", "left_semi").repartition("block"))
    begin = sources.select("cell_id").join(wet.filter("water"), "cell_id", "left_semi").distinct()
    front = cut(with_blocks(begin, block="cell_id").select("cell_id", F.lit(0.0).alias("dist"), "block"))
    # Improvements are only appended; a cell's distance is its smallest entry, and only blocks with news are read.
    log, rounds = front.limit(0), 0
    while not front.isEmpty():
        news = front.select("block").distinct()
        state = (log.join(news, "block", "left_semi").groupBy("cell_id", "block").agg(F.min("dist").alias("dist")).withColumn("fresh", F.lit(False))
                 .unionByName(front.withColumn("fresh", F.lit(True))))
        out = cut(e.join(news, "block", "left_semi").groupBy("block").cogroup(state.groupBy("block"))
                  .applyInPandas(_relaxed, f"cell_id {e.schema['dst'].dataType.simpleString()}, dist double, block int, out boolean"))
        log = log.unionByName(out.filter("not out").drop("out"))
        cand = out.filter("out").groupBy("cell_id", "block").agg(F.min("dist").alias("cand"))
        known = log.join(cand.select("cell_id"), "cell_id", "left_semi").groupBy("cell_id").agg(F.min("dist").alias("dist"))
        front = cut(cand.join(known, "cell_id", "left").filter(F.col("dist").isNull() | (F.col("cand") < F.col("dist"))).select("cell_id", F.col("cand").alias("dist"), "block"))
        rounds += 1
        if rounds % MERGE_EVERY == 0:
            log = cut(log.groupBy("cell_id", "block").agg(F.min("dist").alias("dist")))
    dist = log.groupBy("cell_id").agg(F.min("dist").alias("dist"))
    value = F.when(~F.col("water"), F.lit(float("nan"))).otherwise(F.coalesce("dist", F.lit(float("inf"))))
    return wet.join(dist, "cell_id", "left").select("cell_id", value.alias("dist"))


def unreachable_by_region(cells: DataFrame, dist: DataFrame) -> DataFrame:
    """Water cells without a path, per region."""
    lost = dist.filter(F.col("dist") == float("inf"))
    return cells.join(lost.select("cell_id"), "cell_id", "left_semi").groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))


def components(cells: DataFrame, edges: DataFrame, by: str | None = None) -> DataFrame:
    """(cell_id, component) with the smallest member id, over undirected edges.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so the number of rounds grows with the logarithm of long chains rather than their length. Joins by label or by
    a cell of very many edges deal the rows of a hot key, such as the label of a giant component, over tasks.
    """
    e = edges.select("src", "dst")
    if by:
        k = cells.select("cell_id", by)
        e = (e.join(k.select(F.col("cell_id").alias("src"), F.col(by).alias("ka")), "src")
             .join(k.select(F.col("cell_id").alias("dst"), F.col(by).alias("kb")), "dst").filter(F.col("ka") == F.col("kb")).select("src", "dst"))
    e = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    lab = cut(cells.select("cell_id", F.col("cell_id").alias("component")))
    while True:
        near = (split_join(e, lab.withColumnRenamed("cell_id", "src"), "src", "inner").groupBy(F.col("dst").alias("cell_id")).agg(F.min("component").alias("near")))
        low = cut(lab.join(shuffled(near), "cell_id", "left").select("cell_id", "component", F.least("component", F.coalesce("near", F.col("component"))).alias("low")))
        # Hook: the old label learns the smallest label any of its members saw.
        hook = low.groupBy("component").agg(F.min("low").alias("to"))
        new = cut(split_join(low, hook, "component").select("cell_id", "component", F.least("low", F.coalesce("to", F.col("low"))).alias("nxt")))
        jump = new.select(F.col("cell_id").alias("nxt"), F.col("nxt").alias("further"))
        out = cut(split_join(new, jump, "nxt").select("cell_id", F.least("nxt", F.coalesce("further", F.col("nxt"))).alias("component"), F.col("component").alias("was")))
        changed = not out.filter(F.col("component") != F.col("was")).isEmpty()
        lab = out.select("cell_id", "component")
        if not changed:
            return lab


def component_counts(cells: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """Number of components and the largest size per group."""
    sizes = (labels.join(cells.select("cell_id", by), "cell_id").groupBy(by, "component").agg(F.count(F.lit(1)).alias("n")))
    return sizes.groupBy(by).agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


def hex_round(df: DataFrame, q: str, r: str, row: str, col: str) -> DataFrame:
    """Add the (row, col) of the hex nearest to fractional cube columns q, r, which are dropped.

    Each step is its own projection: the rounding reads its inputs many times, and one nested
    expression would repeat them.
    """
    fq, fr = F.col(q), F.col(r)
    out = df.withColumns({"__a": F.floor(fq + 0.5), "__b": F.floor(fr + 0.5), "__c": F.floor(-fq - fr + 0.5)})
    out = out.withColumns({"__da": F.abs(F.col("__a") - fq), "__db": F.abs(F.col("__b") - fr), "__dc": F.abs(F.col("__c") + fq + fr)})
    fix_q = (F.col("__da") > F.col("__db")) & (F.col("__da") > F.col("__dc"))
    fix_r = ~fix_q & (F.col("__db") > F.col("__dc"))
    out = out.withColumns({"__q": F.when(fix_q, -F.col("__b") - F.col("__c")).otherwise(F.col("__a")).cast("long"),
                           "__r": F.when(fix_r, -F.col("__a") - F.col("__c")).otherwise(F.col("__b")).cast("long")})
    out = out.withColumns({row: F.col("__r"), col: F.col("__q") + ((F.col("__r") - F.pmod("__r", F.lit(2))) / 2).cast("long")})
    return out.drop(q, r, "__a", "__b", "__c", "__da", "__db", "__dc", "__q", "__r")


def point_to_hex(df: DataFrame, x: str, y: str, row: str, col: str, edge: float = 1.0) -> DataFrame:
    """Add the (row, col) of the pointy-top hex that holds the point (x, y)."""
    q = (F.lit(3.0 ** 0.5 / 3.0) * F.col(x) - F.lit(1.0 / 3.0) * F.col(y)) / F.lit(edge)
    r = F.lit(2.0 / 3.0) * F.col(y) / F.lit(edge)
    return hex_round(df.withColumns({"__fq": q, "__fr": r}), "__fq", "__fr", row, col)


def bridge_gaps(cells: DataFrame, labels: DataFrame, max_len: int = 10) -> DataFrame:
    """Cells (row, col) to add so that components within max_len hops of the largest one join it.

    Every orphan cell looks only at the hexes around it within max_len, so candidates are bounded by
    the disc and not by the anchor's size; a component farther away stays apart.
    """
    sized = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    anchor = sized.agg(F.min_by("component", F.struct(-F.col("n"), "component"))).scalar()
    q, r = cube(F.col("row"), F.col("col"))
    at = (cells.join(shuffled(labels), "cell_id").withColumns({"q": q.cast("long"), "r": r.cast("long")})
          .withColumn("home", F.col("component") == anchor))
    disc = [(dq, dr) for dq in range(-max_len, max_len + 1) for dr in range(-max_len, max_len + 1) if abs(dq + dr) <= max_len]
    around = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr"), F.lit(max(abs(a), abs(b), abs(a + b))).alias("hops")) for a, b in disc])
    probe = (at.filter(~F.col("home")).select("component", F.col("q").alias("oq"), F.col("r").alias("orr"), F.explode(around).alias("o"))
             .select("component", "oq", "orr", (F.col("oq") + F.col("o.dq")).alias("q"), (F.col("orr") + F.col("o.dr")).alias("r"), "o.hops"))
    best = (probe.join(shuffled(at.filter("home").select("q", "r")), ["q", "r"]).groupBy("component")
            .agg(F.min(F.struct("hops", "oq", "orr", "q", "r")).alias("b")).select("component", "b.*"))
    t = F.col("i") / F.col("hops")
    # A small fixed offset keeps points on a shared border on one side.
    line = best.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hops").cast("long"))).alias("i")).select(
        (F.col("oq") + 1e-6 + (F.col("q") - F.col("oq")) * t).alias("fq"), (F.col("orr") + 2e-6 + (F.col("r") - F.col("orr")) * t).alias("fr"))
    return hex_round(line, "fq", "fr", "row", "col").distinct().join(shuffled(cells.select("row", "col")), ["row", "col"], "left_anti")


def edge_adjacency(triangles: DataFrame) -> DataFrame:
    """(tri, slot, neighbour): the first other triangle on each side of a triangle.

    Only the two smallest ids per side are needed, so no pairs are formed.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("slot"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                      for i, (a, b) in enumerate([("n0", "n1"), ("n1", "n2"), ("n2", "n0")])])
    s = triangles.select("tri", F.explode(sides).alias("s")).select("tri", "s.*")
    first = s.groupBy("a", "b").agg(F.min("tri").alias("m1"))
    tagged = s.join(shuffled(first), ["a", "b"])
    second = tagged.filter(F.col("tri") != F.col("m1")).groupBy("a", "b").agg(F.min("tri").alias("m2"))
    out = tagged.join(shuffled(second), ["a", "b"], "left")
    nb = F.when(F.col("tri") != F.col("m1"), F.col("m1")).otherwise(F.col("m2"))
    return out.select("tri", "slot", nb.alias("neighbour")).filter("neighbour is not null")


def gradient(cells: DataFrame, edges: DataFrame, field: str, form: str = "unit", geographic: bool = False,
             least: float = 1e-12) -> DataFrame:
    """(cell_id, gy, gx): normalised gradient; (0, 0) without neighbours or direction.

    unit sums the difference times the unit vector to each neighbour; metric sums it times the
    metric difference. Magnitudes below least count as zero: sums in any order leave such noise
    where neighbours cancel, and it has no direction.
    """
    c = cells.select("cell_id", "x", "y", F.col(field).alias("f"))
    e = (edges.join(c.select(F.col("cell_id").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("f").alias("f0")), "src")
         .join(c.select(F.col("cell_id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("f").alias("f1")), "dst"))
    df, dy, dx = F.col("f1") - F.col("f0"), F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    cos = F.cos(F.radians("y0"))
    if form == "unit":
        dx = dx * cos if geographic else dx
        norm = F.sqrt(dy * dy + dx * dx)
        ty, tx = F.when(norm > 0, df * dy / norm).otherwise(0.0), F.when(norm > 0, df * dx / norm).otherwise(0.0)
    else:
        ty = df * dy * (F.lit(110540.0) if geographic else F.lit(1.0))
        tx = df * dx * (F.lit(111320.0) * cos if geographic else F.lit(1.0))
    g = e.groupBy(F.col("src").alias("cell_id")).agg(F.sum(ty).alias("sy"), F.sum(tx).alias("sx"))
    mag = F.sqrt(F.col("sy") * F.col("sy") + F.col("sx") * F.col("sx"))
    ok = mag >= F.lit(least)
    return (cells.select("cell_id").join(g, "cell_id", "left")
            .select("cell_id", F.coalesce(F.when(ok, F.col("sy") / mag), F.lit(0.0)).alias("gy"),
                    F.coalesce(F.when(ok, F.col("sx") / mag), F.lit(0.0)).alias("gx")))


def move_along_network(positions: DataFrame, segments: DataFrame, edges: DataFrame, step: str, seed: int,
                       direction: str = "upstream", key: Key = "agent_id") -> DataFrame:
    """positions(agent_id, segment_id, offset, <step>) moved by one step of at most one segment.

    Past an end the rest of the step enters a random next segment; without one the position stops at
    the end. Next segments are ranked per segment, and the drawn rank joins back.
    """
    up = direction == "upstream"
    nxt = edges.select((F.col("dst") if up else F.col("src")).alias("segment_id"), (F.col("src") if up else F.col("dst")).alias("next_id")).distinct()
    order = ranked(nxt, ["segment_id"], "next_id", "pick")
    n = nxt.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))
    length = segments.select("segment_id", "length")
    p = positions.join(length, "segment_id").join(n, "segment_id", "left")
    raw = F.col("offset") - F.col(step) if up else F.col("offset") + F.col(step)
    inside = (raw >= 0) if up else (raw <= F.col("length"))
    over = (-raw) if up else (raw - F.col("length"))
    u = hash_u(seed, "branch", key)
    p = p.withColumns({"__raw": raw, "__in": inside, "__over": over,
                       "pick": F.when(~inside & F.col("n").isNotNull(), F.least(F.floor(u * F.col("n")), F.col("n") - 1) + 1)})
    p = (p.join(order, ["segment_id", "pick"], "left")
         .join(length.select(F.col("segment_id").alias("next_id"), F.col("length").alias("next_len")), "next_id", "left"))
    entered = F.greatest(F.col("next_len") - F.col("__over"), F.lit(0.0)) if up else F.least(F.col("__over"), F.col("next_len"))
    end = F.lit(0.0) if up else F.col("length")
    return p.select("agent_id", F.when(F.col("__in"), F.col("segment_id")).otherwise(F.coalesce("next_id", "segment_id")).alias("segment_id"),
                    F.when(F.col("__in"), F.col("__raw")).when(F.col("next_id").isNotNull(), entered).otherwise(end).alias("offset"))


def network_range_length(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """ranges(range_id, segments array, start_offset, end_offset) -> (range_id, total_length)."""
    x = ranges.select("range_id", "start_offset", "end_offset", F.size("segments").alias("n"), F.posexplode("segments").alias("i", "segment_id"))
    x = x.join(segments.select("segment_id", "length"), "segment_id")
    part = (F.when(F.col("n") == 1, F.col("end_offset") - F.col("start_offset"))
            .when(F.col("i") == 0, F.col("length") - F.col("start_offset"))
            .when(F.col("i") == F.col("n") - 1, F.col("end_offset")).otherwise(F.col("length")))
    return x.groupBy("range_id").agg(F.sum(part).alias("total_length"))


def line_crossings(lines: DataFrame, cells: DataFrame, edge: float = 1.0, both_ways: bool = True) -> DataFrame:
    """Distinct (src, dst) of neighbouring cells that the lines(line_id, x1, y1, x2, y2) cross.

    The cell of a sample and of the one before it are both computed from the sample number, so no
    ordering of the samples is needed.
    """
    from driftgrid.operators.grid import hex_distance
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2.0)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2.0)))
    n = F.greatest(F.lit(16), F.floor(F.lit(4.0) * length / F.lit(max(edge, 1e-9)))).cast("long")
    s = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)))
    def along(a, b, i):
        return F.col(a) + i / (F.col("n") - 1) * (F.col(b) - F.col(a))
    was, now = F.col("i") - 1, F.col("i")
    s = s.select(along("x1", "x2", was).alias("ax"), along("y1", "y2", was).alias("ay"),
                 along("x1", "x2", now).alias("bx"), along("y1", "y2", now).alias("by"))
    s = point_to_hex(point_to_hex(s, "ax", "ay", "r0", "c0", edge), "bx", "by", "r1", "c1", edge)
    # Later filters must not be rewritten in terms of the rounding, so the result passes a generator.
    s = s.select(F.explode(F.array(F.struct("r0", "c0", "r1", "c1"))).alias("h")).select("h.*")
    s = (s.distinct()
         .filter(hex_distance(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")) == 1))
    ids = cells.select("row", "col", "cell_id")
    e = (s.join(ids.select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("cell_id").alias("src")), ["r0", "c0"])
         .join(ids.select(F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("cell_id").alias("dst")), ["r1", "c1"]).select("src", "dst"))
    if both_ways:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e.distinct()


def cross_level_adjacency(cells: DataFrame, levels: int = 3) -> DataFrame:
    """(src, dst) of a mixed-level square grid cells(cell_id, level, x, y); a child halves its parent.

    Same level first; where a ring position is missing, the coarser cell that holds its centre (the
    nearest level wins), and the finer cells inside it, up to levels steps away.
    """
    here = cells.select("cell_id", "level", "x", "y")
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)])
    ring = (here.select(F.col("cell_id").alias("src"), "level", "x", "y", F.explode(offs).alias("o"))
            .select("src", "level", (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y")))
    same = ring.join(here.withColumnRenamed("cell_id", "dst"), ["level", "x", "y"]).select("src", "dst")
    gap = ring.join(here.select("level", "x", "y"), ["level", "x", "y"], "left_anti")
    key = here.withColumnRenamed("cell_id", "dst")
    ups = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(2 ** k).alias("f")) for k in range(1, levels + 1)])
    coarse = (gap.select("src", "level", "x", "y", F.explode(ups).alias("u"))
              .select("src", "x", "y", F.col("level").alias("from_level"), F.col("u.k").alias("k"), (F.col("level") - F.col("u.k")).alias("level"),
                      F.floor(F.col("x") / F.col("u.f")).cast("long").alias("px"), F.floor(F.col("y") / F.col("u.f")).cast("long").alias("py"))
              .join(key.withColumnsRenamed({"x": "px", "y": "py"}), ["level", "px", "py"])
              .groupBy("src", "from_level", "x", "y").agg(F.min_by("dst", "k").alias("dst")).select("src", "dst"))
    # A finer cell finds its own ancestors, so each one meets at most `levels` gap positions.
    fine = (key.select("dst", "level", "x", "y", F.explode(ups).alias("u"))
            .select("dst", (F.col("level") - F.col("u.k")).alias("level"), F.floor(F.col("x") / F.col("u.f")).cast("long").alias("x"),
                    F.floor(F.col("y") / F.col("u.f")).cast("long").alias("y"))
            .join(gap, ["level", "x", "y"]).select("src", "dst"))
    return same.unionByName(coarse).unionByName(fine).filter(F.col("src") != F.col("dst")).distinct()
