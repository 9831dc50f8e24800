"""Properties of the operators that have no SQL twin, and brute-force replays."""

import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.catalog import QUERIES
from driftgrid.operators import encounters as enc
from driftgrid.operators import generation as gen
from driftgrid.operators import graph as g
from driftgrid.operators import neighbours as nb
from driftgrid.operators import spatial as spa
from driftgrid.operators import steps
from driftgrid.operators import territories as ter
from driftgrid.operators import traits
from driftgrid.operators.grid import EVEN_OFFSETS, ODD_OFFSETS, hex_adjacency
from driftgrid.plans import star


def population(spark, rows):
    return spark.createDataFrame(rows, "agent_id long, cell long, alive boolean")


@pytest.fixture(scope="module")
def crowd(spark):
    a = population(spark, [(i, i % 3, i % 7 != 0) for i in range(60)])
    b = population(spark, [(1000 + i, i % 4, i % 5 != 0) for i in range(400)])
    return a, b


def test_encounters_p_zero_and_one(crowd):
    a, b = crowd
    assert enc.kills(a, b, 0.0, 1).count() == 0
    sure = enc.kills(a, b, 1.0, 1)
    first = {r["cell"]: r["m"] for r in a.filter("alive").groupBy("cell").agg(F.min("agent_id").alias("m")).collect()}
    rows = sure.collect()
    assert len(rows) == b.filter("alive and cell < 3").count()
    assert all(r["predator_id"] == first[r["cell"]] for r in rows)
    t = enc.encounter_totals(a, b, 1.0, 1).agg(F.sum("pairs"), F.sum("encounters"), F.sum("kills")).first()
    assert t[0] == t[1] and t[2] == len(rows)


def test_encounters_dead_and_unshared(crowd):
    a, b = crowd
    k = enc.kills(a, b, 0.3, 5)
    dead = b.filter("not alive").select(F.col("agent_id").alias("prey_id"))
    assert k.join(dead, "prey_id").count() == 0 and k.filter("cell = 3").count() == 0
    assert k.select("prey_id").distinct().count() == k.count()
    assert enc.survivors(b, k).count() == b.count() - k.count()


def test_encounter_distribution(spark):
    """Kill probability 1-(1-p)^n and mean encounters n*m*p, as with pairwise dice."""
    n, m, p = 12, 20000, 0.07
    a = population(spark, [(i, 0, True) for i in range(n)])
    b = spark.range(m).select((F.col("id") + 100).alias("agent_id"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("alive"))
    k = enc.kills(a, b, p, 9)
    counts = {r["predator_id"]: r["count"] for r in k.groupBy("predator_id").count().collect()}
    assert sum(counts.values()) / m == pytest.approx(1 - (1 - p) ** n, abs=0.012)
    for i in (0, 5, 11):
        assert counts[i] / m == pytest.approx(p * (1 - p) ** i, abs=0.008)
    t = enc.encounter_totals(a, b, p, 9).first()
    assert t["encounters"] == pytest.approx(n * m * p, rel=0.03) and t["kills"] == sum(counts.values())


def test_binomial_draws_have_the_right_moments(spark):
    p, sizes = 0.07, [1, 5, 1000, 70_000, 1 << 16, 3_000_000]
    rows = spark.createDataFrame([(k * 1000 + i, m) for k, m in enumerate(sizes) for i in range(400)], "cell long, n long")
    got = enc.binomial(rows, ["cell"], "n", p, 5, "t").toPandas().set_index("cell")["hits"].sort_index()
    for k, m in enumerate(sizes):
        x = got.loc[k * 1000:k * 1000 + 399]
        sd = math.sqrt(m * p * (1 - p))
        assert len(x) == 400 and x.between(0, m).all() and abs(x.mean() - m * p) < 4 * sd / 20 and (m < 1000 or 0.85 < x.std() / sd < 1.15)
    low, cdf = enc.binomial_table(10, 0.3)
    assert low == 0 and cdf == pytest.approx([sum(math.comb(10, j) * 0.3 ** j * 0.7 ** (10 - j) for j in range(i + 1)) for i in range(10)])
    odd = spark.createDataFrame([(None, 5), (None, 4), (3, 0)], "cell long, n long")
    assert [tuple(r) for r in enc.binomial(odd, ["cell"], "n", 1.0, 5, "t").collect()] == [(None, 9)]
    assert [r["cell"] for r in enc.binomial(odd, ["cell"], "n", 0.5, 5, "t").collect()] == [None]


def test_gains_conserve(crowd):
    a, b = crowd
    k = enc.kills(a, b, 0.2, 3)
    out = enc.gains(a.withColumn("acc", F.lit(1.0)), k, "acc", 2.5)
    assert out.agg(F.sum("acc")).first()[0] == pytest.approx(a.count() + 2.5 * k.count())


def serial_expand(ranges, edges, worth, threshold, most):
    owner = {c: o for o, c in ranges}
    own = {}
    for o, c in ranges:
        own.setdefault(o, set()).add(c)
    for o in sorted(own):
        room = most - len(own[o])
        if room <= 0:
            continue
        frontier = {d for c in own[o] for d in edges.get(c, ()) if d not in owner}
        for c in sorted((d for d in frontier if worth[d] >= threshold), key=lambda d: (-worth[d], d))[:room]:
            owner[c] = o
    return sorted((o, c) for c, o in owner.items() if (o, c) not in set(ranges))


@pytest.mark.parametrize("seed", range(4))
def test_expansion_equals_serial_order(spark, seed):
    rnd = random.Random(seed)
    n = 120
    edges = {c: rnd.sample(range(n), 5) for c in range(n)}
    worth = {c: float(rnd.randrange(8)) for c in range(n)}
    ranges = sorted((rnd.randrange(12), c) for c in rnd.sample(range(n), 40))
    got = ter.expand_ranges(spark.createDataFrame(ranges, "owner long, cell_id long"), spark.createDataFrame([(c, d, i) for c, ds in edges.items() for i, d in enumerate(ds)], "src long, dst long, slot int"),
                            spark.createDataFrame(list(worth.items()), "cell_id long, v double"), "v", 2.0, 8)
    assert sorted((r["owner"], r["cell_id"]) for r in got.collect()) == serial_expand(ranges, edges, worth, 2.0, 8)


def hex_nbrs(r, c):
    return [(r + dr, c + dc) for dr, dc in (EVEN_OFFSETS if r % 2 == 0 else ODD_OFFSETS)]


def flood(cells):
    left, parts = set(cells), []
    while left:
        todo, part = deque([left.pop()]), set()
        while todo:
            x = todo.popleft()
            part.add(x)
            for y in hex_nbrs(*x):
                if y in left:
                    left.remove(y)
                    todo.append(y)
        parts.append(part)
    return parts


@pytest.mark.parametrize("seed", range(3))
def test_components_and_bridges(spark, seed):
    rnd = random.Random(seed)
    width = 30
    cells = {(r, c) for r in range(20) for c in range(width) if rnd.random() < 0.35}
    df = spark.createDataFrame([(r * width + c, r, c) for r, c in cells], "cell_id long, row long, col long")
    lab = g.components(df, hex_adjacency(df, width))
    parts = flood(cells)
    want = {frozenset(r * width + c for r, c in p) for p in parts}
    got = {}
    for r in lab.collect():
        got.setdefault(r["component"], set()).add(r["cell_id"])
    assert {frozenset(v) for v in got.values()} == want
    assert all(min(v) == k for k, v in got.items())
    reach = 3
    added = {(r["row"], r["col"]) for r in g.bridge_gaps(df, lab, reach).collect()}
    assert not added & cells
    home = max(parts, key=lambda p: (len(p), -min(r * width + c for r, c in p)))

    def near(part):
        ring, seen = set(part), set(part)
        for k in range(1, reach + 1):
            ring = {y for x in ring for y in hex_nbrs(*x)} - seen
            seen |= ring
            if ring & home:
                return k
        return None
    joined = next(p for p in flood(cells | added) if home <= p)
    for p in parts:
        if near(p) is not None:
            assert p <= joined, "a component within reach stays apart"


def test_line_crossings_are_neighbours(spark, sf):
    e = QUERIES["grf17_line_crossings"](spark, sf).collect()
    adj = {(r["src"], r["dst"]) for r in hex_adjacency(star.cells(spark, sf), star.WIDTH).collect()}
    assert e and all((r["src"], r["dst"]) in adj for r in e)


def test_distance_against_dijkstra(spark):
    import heapq
    rnd = random.Random(3)
    n = 150
    edges = [(a, b, rnd.uniform(1, 9)) for a in range(n) for b in rnd.sample(range(n), 3) if a != b]
    water = {i: rnd.random() < 0.85 for i in range(n)}
    src = [i for i in range(5) if water[i]]
    dist, heap = {s: 0.0 for s in src}, [(0.0, s) for s in src]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for a, b, w in edges:
            if a == u and water[b] and d + w < dist.get(b, math.inf):
                dist[b] = d + w
                heapq.heappush(heap, (d + w, b))
    cells = spark.createDataFrame(list(water.items()), "cell_id long, water boolean")
    for size in (40, g.BLOCK_CELLS):
        out = g.distance_from_sources(cells, spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(s,) for s in src], "cell_id long"), block_cells=size)
        for r in out.collect():
            c = r["cell_id"]
            if not water[c]:
                assert math.isnan(r["dist"])
            else:
                assert r["dist"] == pytest.approx(dist.get(c, math.inf))


def test_distance_along_a_chain_takes_a_round_per_border(spark, monkeypatch):
    n, rounds, cut = 2000, [], g.cut
    monkeypatch.setattr(g, "cut", lambda df: rounds.append(1) or cut(df))
    cells = spark.range(n).select(F.col("id").alias("cell_id"), F.lit(True).alias("water"))
    chain = spark.range(1, n).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    out = g.distance_from_sources(cells, chain, cells.limit(1).select("cell_id"), block_cells=250)
    assert out.filter("dist = cell_id").count() == n and len(rounds) <= 2 * 10 + 5


def test_walk_modes(spark):
    cells = spark.createDataFrame([(i, float(i), 1) for i in range(10)], "cell_id long, v double, n_micro int")
    e = spark.createDataFrame([(i, j, k) for i in range(10) for k, j in enumerate((i - 1, i + 1)) if 0 <= j < 10], "src long, dst long, slot int")
    adj = nb.adjacency(cells, e, ("v", "n_micro"))
    a = spark.createDataFrame([(1, 2), (2, 9)], "agent_id long, cell long")
    up = {r["agent_id"]: (r["walk_cell"], r["distance"]) for r in nb.bounded_walk(a, adj, "v", "gradient", 6, 1, halt=3.0).collect()}
    assert up == {1: (5, 3.0), 2: (9, 0.0)}
    budget = {r["agent_id"]: (r["walk_cell"], r["budget"]) for r in nb.bounded_walk(a, adj, "v", "directed", 4, 1).collect()}
    assert budget[1] == (3, 0.0) and budget[2] == (8, 0.0)      # one hop per cell; the best neighbour may be worse
    cold = {r["agent_id"]: r["walk_cell"] for r in nb.bounded_walk(a, adj, "v", "cold", 1, 1, threshold=5.0).collect()}
    assert cold == {1: 2, 2: 8}


@pytest.mark.parametrize("p", [0.0, 1.0])
def test_barriers_at_the_ends(spark, p):
    moves = spark.createDataFrame([(i, 0, 1) for i in range(20)] + [(99, 0, 0), (98, 1, 0)], "agent_id long, cell long, new_cell long")
    probs = spark.createDataFrame([(0, 1, p, 1.0 - p)], "src long, dst long, p_mort double, p_defl double")
    got = {r["agent_id"]: (r["outcome"], r["final_cell"]) for r in nb.barrier_outcome(moves, probs, 4).collect()}
    assert got[99] == ("passed", 0) and got[98] == ("passed", 0)
    assert {got[i] for i in range(20)} == ({("died", 1)} if p else {("deflected", 0)})


def test_nearest_cell_brute_force(spark):
    from driftgrid.operators.nearest import nearest_cell
    rng = np.random.default_rng(5)
    c = rng.uniform(0, 50, (300, 2))
    pts = np.vstack([rng.uniform(-40, 120, (200, 2)), [[1000.0, -700.0]]])
    got = {r["point_id"]: r["cell_id"] for r in nearest_cell(
        spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "point_id long, x double, y double"),
        spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(c)], "cell_id long, x double, y double"), 1.5).collect()}
    want = {i: int(np.argmin(((c - p) ** 2).sum(axis=1))) for i, p in enumerate(pts)}
    assert got == want


def test_recombination_keeps_parent_alleles(spark, sf):
    from driftgrid.operators.genetics import gametes
    kids = spark.range(500).select(F.col("id").alias("child_id"), (F.col("id") % 10).alias("parent_id"))
    geno = star.genotypes(spark, sf)
    out = gametes(kids, geno, 3).join(kids, "child_id").join(geno.withColumnRenamed("agent_id", "parent_id"), ["parent_id", "locus_idx"])
    assert out.count() == 2000
    assert out.filter((F.col("allele") != F.col("a0")) & (F.col("allele") != F.col("a1"))).count() == 0


def test_identity_matrix_does_not_mutate(spark, sf):
    from driftgrid.operators.genetics import mutate
    eye = [[1.0 if i == j else 0.0 for j in range(3)] for i in range(3)]
    assert mutate(star.genotypes(spark, sf), "A", eye, 1).agg(F.sum("changed")).first()[0] == 0


def test_nothing_uses_local_checkpoints():
    from pathlib import Path
    root = Path(__file__).resolve().parent.parent / "driftgrid"
    assert not [p for p in root.rglob("*.py") if "local" + "Checkpoint" in p.read_text()]


@pytest.fixture(scope="module")
def lives(spark):
    """Individuals with gaps, dead and arrived stretches; one holds a third of the rows."""
    rnd = random.Random(11)
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 15), i, rnd.random() < 0.8, rnd.random() < 0.1, float(rnd.randrange(100)), rnd.randrange(4)) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "agent_id long, time long, alive boolean, arrived boolean, v double, behavior int")


@pytest.mark.parametrize("span", [1, 5, 64, 10 ** 9])
def test_rolling_and_residence_for_any_span(lives, span):
    from driftgrid.operators import tracks as trk
    rows, df = lives
    memo, want = {}, {}
    for a, t, alive, arrived, v, b in rows:
        h, hours, since, mean = memo.get(a, ([15.0] * 3, 0, 999, 15.0))
        if alive and not arrived:
            h = [v, *h[:2]]
            mean = sum(h) / 3
            hours, since = (hours + 1, 0) if b == 2 else (0, since + 1)
        memo[a] = (h, hours, since, mean)
        want[t] = (mean, hours, since)
    mean = {r["time"]: r["mean3"] for r in trk.rolling_mean3(df, "v", span=span).collect()}
    res = {r["time"]: (r["hours_in"], r["steps_since"]) for r in trk.residence_counters(df, F.col("behavior") == 2, span=span).collect()}
    assert len(mean) == len(res) == len(rows)
    for t, (m, h, s) in want.items():
        assert mean[t] == pytest.approx(m) and res[t] == (h, s)


def test_draws_change_with_the_step(spark):
    """Keyed by step, a chance of 5 % hits 1 - 0.95^50 of all individuals in 50 steps; by individual alone, 5 %."""
    rows = spark.range(2000).select(F.col("id").alias("agent_id"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("time"))
    def share(key):
        out = gen.bernoulli(rows, "hit", 0.05, 1, "each", key).groupBy("agent_id").agg(F.max(F.col("hit").cast("int")).alias("m"))
        return out.agg(F.avg("m")).first()[0]
    assert share(("agent_id", "time")) == pytest.approx(1 - 0.95 ** 50, abs=0.02)
    assert share("agent_id") == pytest.approx(0.05, abs=0.02)


def test_repeated_steps_draw_anew(spark):
    df = spark.range(2000).select(F.col("id").alias("agent_id"), F.lit(0).alias("stage"))
    step = lambda d: traits.markov_transition(d, "stage", [[0.9, 0.1], [0.0, 1.0]], 3, ("agent_id", "iteration"))
    assert steps.repeat(df, [step], 10).agg(F.avg("stage")).first()[0] == pytest.approx(1 - 0.9 ** 10, abs=0.04)


def test_bilinear_of_layers_against_loops(spark):
    rng, ni, nj, nan = np.random.default_rng(5), 6, 5, float("nan")
    layers = {(t, v): rng.normal(size=(ni, nj)) for t in range(3) for v in ("so", "tos")}
    layers[1, "so"][2:5, 1:4] = nan                  # a hole
    layers[2, "tos"][:] = nan                        # nothing to fill from
    rows = [(t, v, i, j, float(z[i, j])) for (t, v), z in layers.items() for i in range(ni) for j in range(nj) if i + j != 7]   # some nodes are absent
    grid = spark.createDataFrame(rows, "t int, var string, gi long, gj long, value double")
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform((9, 19), (17, 24), (60, 2)))]
    pts = spark.createDataFrame(points, "point_id int, lat double, lon double")
    (lat0, lon0), (dlat, dlon) = (10.0, 20.0), (1.0, 0.5)
    for fill in (True, False):
        out = spa.bilinear(pts, grid, (lat0, lon0), (dlat, dlon), (ni, nj), keys=("t", "var"), fill=fill)
        got = {(r["point_id"], r["t"], r["var"]): r["value"] for r in out.collect()}
        assert len(got) == len(points) * len(layers)
        for (t, v), z in layers.items():
            node = {(i, j): z[i, j] for i in range(ni) for j in range(nj) if i + j != 7 and not math.isnan(z[i, j])}
            for k, lat, lon in points:
                fi, fj = (lat - lat0) / dlat, (lon - lon0) / dlon
                i, j = min(max(math.floor(fi), 0), ni - 2), min(max(math.floor(fj), 0), nj - 2)
                corners = [node.get((i + a, j + b), nan) * abs(1 - a - (fi - i)) * abs(1 - b - (fj - j)) for a in (0, 1) for b in (0, 1)]
                want = sum(corners) if 0 <= fi <= ni - 1 and 0 <= fj <= nj - 1 else nan
                if fill and math.isnan(want) and node:
                    want = node[min(node, key=lambda n: math.hypot(lat0 + n[0] * dlat - lat, lon0 + n[1] * dlon - lon))]
                assert got[k, t, v] == pytest.approx(want, nan_ok=True), (k, t, v, fill)
    assert spa.bilinear(pts, grid.limit(0), (lat0, lon0), (dlat, dlon), (ni, nj), keys=("t", "var")).count() == 0
