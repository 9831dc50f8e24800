"""Queries for lookups, neighbour moves and encounters."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.operators import encounters as enc
from driftgrid.operators import lookups as lk
from driftgrid.operators import neighbours as nb
from driftgrid.operators.nearest import nearest_cell
from driftgrid.plans import star
from driftgrid.plans.skew import shuffled
from driftgrid.plans.star import FIELD_STEPS, SEED, sql_u, with_views

CELL_VALUE = ("resource", "dist", "x", "y")


def adj(spark, d, *attrs):
    return nb.adjacency(star.cells(spark, d), star.edges(spark, d), attrs)


@query("join1_sample_field", with_views("tracks", "field") + f"""SELECT agent_id, "time", temperature, salinity FROM tracks
  LEFT JOIN field ON cell = cell_id AND t = "time" % {FIELD_STEPS}""")
def join1(spark, d):
    t = star.tracks(spark, d).withColumn("t", lk.align_time_wrap(F.col("time"), FIELD_STEPS))
    return lk.sample_field(t, star.field(spark, d), ["temperature", "salinity"], ("cell", "t")).select("agent_id", "time", "temperature", "salinity")


SQL_ZONE = "zones AS (SELECT (l_linenumber - 1)::INTEGER AS zone, (datediff('day', DATE '1995-01-01', l_shipdate::DATE) % 24)::INTEGER AS t, avg(l_quantity) AS temperature FROM lineitem GROUP BY 1, 2)"


def zones(spark, d):
    return (star.table(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("int").alias("zone"), (star.day_of("l_shipdate") % 24).cast("int").alias("t"))
            .agg(F.avg("l_quantity").alias("temperature")))


@query("join2_zone_field", with_views("cells") + f""", {SQL_ZONE} SELECT cell_id, greatest(region_id, 0) AS zone, 4 AS t, temperature FROM cells
  LEFT JOIN zones ON zone = greatest(region_id, 0) AND t = 4""")
def join2(spark, d):
    c = star.cells(spark, d).withColumn("zone_raw", F.col("region_id") + 1)
    return lk.zone_field(c, zones(spark, d), 100, 24, "temperature")


@query("join3_align_time", with_views("tracks") + """SELECT agent_id, "time", "time" % 24 AS wrapped,
  least(CASE WHEN "time" < 30 THEN "time" ELSE "time" // greatest(1, ("time" + 1) // 30) END, 29)::INTEGER AS clamped FROM tracks""")
def join3(spark, d):
    return star.tracks(spark, d).select("agent_id", "time", lk.align_time_wrap(F.col("time"), 24).alias("wrapped"),
                                        lk.align_time_clamp(F.col("time"), 30).alias("clamped"))


PP = with_views("predators", "prey")
P = 0.05
SQL_KILLS = PP + f""", pr AS (SELECT cell, agent_id AS predator_id, row_number() OVER (PARTITION BY cell ORDER BY agent_id) - 1 AS hit FROM predators WHERE alive),
  dr AS (SELECT cell, agent_id AS prey_id, floor(ln(1 - {sql_u('encounter', 'agent_id')}) / ln(1 - {P}::DOUBLE))::BIGINT AS hit FROM prey WHERE alive),
  k AS (SELECT cell, predator_id, prey_id FROM dr JOIN pr USING (cell, hit))
"""


def killed(spark, d):
    return enc.kills(star.predators(spark, d), star.prey(spark, d), P, SEED)


@query("join4_co_located", PP + """, n AS (SELECT cell, n_a, n_b FROM (SELECT cell, count(*) AS n_a FROM predators WHERE alive GROUP BY 1) JOIN (SELECT cell, count(*) AS n_b FROM prey WHERE alive GROUP BY 1) USING (cell))
  SELECT cell, side, agent_id, n_a, n_b FROM (SELECT cell, 'a' AS side, agent_id FROM predators WHERE alive UNION ALL SELECT cell, 'b', agent_id FROM prey WHERE alive) JOIN n USING (cell)""")
def join4(spark, d):
    return enc.co_located(star.predators(spark, d), star.prey(spark, d))


@query("join5_kills", SQL_KILLS + "SELECT cell, predator_id, prey_id FROM k")
def join5(spark, d):
    return killed(spark, d)


@query("join5_survivors", SQL_KILLS + "SELECT agent_id, cell, alive FROM prey WHERE agent_id NOT IN (SELECT prey_id FROM k)")
def join5s(spark, d):
    return enc.survivors(star.prey(spark, d), killed(spark, d)).select("agent_id", "cell", "alive")


@query("join5_gains", SQL_KILLS + "SELECT agent_id, acc1 + coalesce(n, 0) * 2.5::DOUBLE AS acc1 FROM predators LEFT JOIN (SELECT predator_id, count(*) AS n FROM k GROUP BY 1) ON predator_id = agent_id")
def join5g(spark, d):
    return enc.gains(star.predators(spark, d), killed(spark, d), "acc1", 2.5).select("agent_id", "acc1")


BITS = enc.TRIAL_BITS
SQL_TOTALS = PP + f""", na AS (SELECT cell, count(*) AS n_a FROM predators WHERE alive GROUP BY 1), nb AS (SELECT cell, count(*) AS n_b FROM prey WHERE alive GROUP BY 1),
  dr AS (SELECT cell, floor(ln(1 - {sql_u('encounter', 'agent_id')}) / ln(1 - {P}::DOUBLE))::BIGINT AS hit FROM prey WHERE alive),
  per AS (SELECT cell, n_a, n_b, count(*) FILTER (hit < n_a) AS kills, coalesce(sum(n_a - 1 - hit) FILTER (hit < n_a), 0)::BIGINT AS rest FROM dr JOIN na USING (cell) JOIN nb USING (cell) GROUP BY 1, 2, 3),
  part AS (SELECT cell, k AS bits, 0 AS part FROM per, range(0, {BITS}) t(k) WHERE (rest >> k) & 1 = 1 UNION ALL SELECT cell, {BITS}, unnest(range(1, (rest >> {BITS}) + 1)) FROM per),
  lim AS (SELECT k, 1::BIGINT << k AS n, sqrt((1::BIGINT << k) * {P}::DOUBLE * {1 - P}::DOUBLE) AS sd FROM range(0, {BITS + 1}) t(k)),
  ends AS (SELECT k, n, greatest(0, floor(n * {P}::DOUBLE - 14 * sd - 14))::BIGINT AS a, least(n, ceil(n * {P}::DOUBLE + 14 * sd + 14))::BIGINT AS b FROM lim),
  pmf AS (SELECT k, a, b, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({P}::DOUBLE) + (n - i) * ln(1 - {P}::DOUBLE)) AS f FROM (SELECT *, unnest(range(a, b + 1)) AS i FROM ends)),
  cdf AS (SELECT k, a, c FROM (SELECT k, a, b, i, sum(f) OVER (PARTITION BY k ORDER BY i) AS c FROM pmf) WHERE i < b),
  u AS (SELECT cell, bits, {sql_u('encounter.rest', 'cell', 'bits', 'part')} AS u FROM part),
  x AS (SELECT u.cell, u.bits, u.u, ends.a + (SELECT count(*) FROM cdf WHERE cdf.k = u.bits AND cdf.c <= u.u) AS hits FROM u JOIN ends ON ends.k = u.bits),
  ex AS (SELECT cell, sum(hits)::BIGINT AS hits FROM x GROUP BY 1)
  SELECT cell, n_a * n_b AS pairs, kills + coalesce(hits, 0) AS encounters, kills FROM per LEFT JOIN ex USING (cell)"""


@query("join5_encounter_totals", SQL_TOTALS)
def join5t(spark, d):
    return enc.encounter_totals(star.predators(spark, d), star.prey(spark, d), P, SEED)


@query("join6_neighbour_join", with_views("edges") + "SELECT src AS cell_id, dst AS neighbour, slot FROM edges")
def join6(spark, d):
    return lk.row_neighbours(star.cells(spark, d), star.edges(spark, d))


AE = with_views("agents", "edges") + """, n AS (SELECT a.*, e.dst, e.slot, c.resource, c.dist, c.x, c.y, h.resource AS h_resource, h.dist AS h_dist, h.x AS hx, h.y AS hy
   FROM agents a LEFT JOIN edges e ON e.src = a.cell LEFT JOIN cells c ON c.cell_id = e.dst LEFT JOIN cells h ON h.cell_id = a.cell)
"""


@query("join7_best_neighbour", AE + """SELECT agent_id, CASE WHEN dist > h_dist THEN dst ELSE cell END AS improved, coalesce(dst, cell) AS always FROM n
  QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY dist DESC, slot) = 1""")
def join7(spark, d):
    a, g = star.agents(spark, d).select("agent_id", "cell"), adj(spark, d, "dist")
    out = nb.best_neighbour(a, g, "dist").withColumnRenamed("new_cell", "improved")
    return nb.best_neighbour(out, g, "dist", must_improve=False).select("agent_id", "improved", F.col("new_cell").alias("always"))


@query("join7_best_neighbour_down", AE + """SELECT agent_id, CASE WHEN dist < h_dist THEN dst ELSE cell END AS new_cell FROM n
  QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY dist, slot) = 1""")
def join7d(spark, d):
    return nb.best_neighbour(star.agents(spark, d).select("agent_id", "cell"), adj(spark, d, "dist"), "dist", ascending=False).select("agent_id", "new_cell")


@query("join8_toward_target", with_views("agents", "edges") + """, tg AS (SELECT agent_id, cell, CASE WHEN stage = 0 THEN -1 ELSE agent_id END AS target FROM agents),
  n AS (SELECT tg.*, dst, slot, power(c.x - t.x, 2) + power(c.y - t.y, 2) AS d, power(h.x - t.x, 2) + power(h.y - t.y, 2) AS hd FROM tg LEFT JOIN edges ON src = cell
   LEFT JOIN cells c ON c.cell_id = dst LEFT JOIN cells t ON t.cell_id = target LEFT JOIN cells h ON h.cell_id = cell)
  SELECT agent_id, CASE WHEN target >= 0 AND d < hd THEN dst ELSE cell END AS new_cell FROM n QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY d, slot) = 1""")
def join8(spark, d):
    a = star.agents(spark, d).select("agent_id", "cell", F.when(F.col("stage") == 0, F.lit(-1)).otherwise(F.col("agent_id")).alias("target"))
    return nb.toward_target(a, adj(spark, d, "x", "y"), star.cells(spark, d)).select("agent_id", "new_cell")


@query("join9_pick_affinity", AE + """, ok AS (SELECT *, abs(dist - h_dist) BETWEEN 0.5 AND 2.0 + stage AND dist > h_dist AS good FROM n)
  SELECT agent_id, CASE WHEN good THEN dst ELSE -1 END AS target, CASE WHEN good THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS error FROM ok
  QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY coalesce(good, false) DESC, dist DESC, slot) = 1""")
def join9(spark, d):
    a = star.agents(spark, d).select("agent_id", "cell", "stage")
    return nb.pick_affinity(a, adj(spark, d, "dist"), "dist", F.lit(0.5), F.lit(2.0) + F.col("stage")).select("agent_id", "target", "error")


@query("join10_flow_neighbour", AE + f""", cu AS (SELECT cell_id, (dist - 2.5) / 5 AS u, (resource - 3) / 6 AS v FROM cells),
  f AS (SELECT n.agent_id, n.cell, dst, slot, sqrt(u * u + v * v) AS sp, round((x - hx) / (sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) + 1e-12::DOUBLE) * (u / (sqrt(u * u + v * v) + 1e-12::DOUBLE))
    + (y - hy) / (sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) + 1e-12::DOUBLE) * (v / (sqrt(u * u + v * v) + 1e-12::DOUBLE)), 12) AS dot FROM n LEFT JOIN cu ON cu.cell_id = n.cell)
  SELECT agent_id, CASE WHEN sp >= 0.01 AND {sql_u('drift', 'agent_id')} < least(sp * 5, 0.8) AND dst IS NOT NULL THEN dst ELSE cell END AS new_cell FROM f
  QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY dot DESC, slot) = 1""")
def join10(spark, d):
    c = star.cells(spark, d).withColumns({"u": (F.col("dist") - 2.5) / 5, "v": (F.col("resource") - 3) / 6})
    g = nb.adjacency(c, star.edges(spark, d), ("x", "y", "u", "v"))
    return nb.flow_neighbour(star.agents(spark, d).select("agent_id", "cell"), g, SEED).select("agent_id", "new_cell")


@query("join11_cold_neighbour", AE + """SELECT agent_id, CASE WHEN h_dist < 2 OR dst IS NULL THEN cell ELSE dst END AS new_cell FROM n
  QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY dist, slot) = 1""")
def join11(spark, d):
    return nb.cold_neighbour(star.agents(spark, d).select("agent_id", "cell"), adj(spark, d, "dist"), "dist", 2.0).select("agent_id", "new_cell")


SQL_RANDOM = AE + f""", rn AS (SELECT agent_id, cell, dst, row_number() OVER (PARTITION BY agent_id ORDER BY slot) - 1 AS k, count(dst) OVER (PARTITION BY agent_id) AS n,
   {sql_u('hop', 'agent_id')} AS u FROM n), mv AS (SELECT agent_id, cell, coalesce(dst, cell) AS new_cell FROM rn WHERE k = least(floor(u * n), greatest(n - 1, 0)))
"""


def random_moves(spark, d):
    return nb.random_neighbour(star.agents(spark, d).select("agent_id", "cell"), adj(spark, d), SEED)


@query("join12_random_neighbour", SQL_RANDOM + "SELECT agent_id, new_cell FROM mv")
def join12(spark, d):
    return random_moves(spark, d).select("agent_id", "new_cell")


def edge_probs(spark, d):
    """Edges into the most valuable cells carry outcome probabilities."""
    c = star.cells(spark, d).filter("depth >= 25").select(F.col("cell_id").alias("dst"))
    return star.edges(spark, d).join(shuffled(c), "dst", "left_semi").select("src", "dst", F.lit(0.2).alias("p_mort"), F.lit(0.5).alias("p_defl"), F.lit(0.3).alias("p_trans"))


@query("join13_barrier_outcome", SQL_RANDOM + f""", o AS (SELECT agent_id, cell, new_cell, CASE WHEN cell <> new_cell AND depth >= 25 AND {sql_u('barrier', 'agent_id')} < 0.2::DOUBLE THEN 'died'
   WHEN cell <> new_cell AND depth >= 25 AND {sql_u('barrier', 'agent_id')} < 0.7::DOUBLE THEN 'deflected' ELSE 'passed' END AS outcome FROM mv LEFT JOIN cells ON cell_id = new_cell)
  SELECT agent_id, outcome, CASE WHEN outcome = 'deflected' THEN cell ELSE new_cell END AS final_cell FROM o""")
def join13(spark, d):
    return nb.barrier_outcome(random_moves(spark, d), edge_probs(spark, d), SEED).select("agent_id", "outcome", "final_cell")


CLASSES = {"A": ((0.1, 0.2, 0.7), (0.0, 0.5, 0.5)), "N": ((0.0, 0.1, 0.9), (0.0, 0.0, 1.0))}


@query("join14_barrier_classes", """SELECT CASE k WHEN 0 THEN l_orderkey ELSE l_partkey END AS src, CASE k WHEN 0 THEN l_partkey ELSE l_orderkey END AS dst,
  CASE WHEN l_returnflag = 'A' AND k = 0 THEN 0.1 ELSE 0.0 END::DOUBLE AS p_mort,
  CASE l_returnflag WHEN 'A' THEN CASE k WHEN 0 THEN 0.2 ELSE 0.5 END WHEN 'N' THEN CASE k WHEN 0 THEN 0.1 ELSE 0.0 END ELSE 1.0 END::DOUBLE AS p_defl,
  CASE l_returnflag WHEN 'A' THEN CASE k WHEN 0 THEN 0.7 ELSE 0.5 END WHEN 'N' THEN CASE k WHEN 0 THEN 0.9 ELSE 1.0 END ELSE 0.0 END::DOUBLE AS p_trans
  FROM lineitem, (VALUES (0), (1)) t(k)""")
def join14(spark, d):
    e = star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("class_name"))
    return lk.barrier_classes(e, CLASSES)


@query("join15_nearest_cell", with_views("cells") + """, pt AS (SELECT c_custkey AS point_id, (c_acctbal + 1000) / 130 - 5 AS px, c_custkey / 18.0::DOUBLE - 5 AS py FROM customer)
  SELECT point_id, cell_id, round(sqrt(power(x - px, 2) + power(y - py, 2)), 6) AS dist FROM pt, cells
  QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY sqrt(power(x - px, 2) + power(y - py, 2)), cell_id) = 1""")
def join15(spark, d):
    pts = star.table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), ((F.col("c_acctbal") + 1000) / 130 - 5).alias("x"), (F.col("c_custkey") / 18.0 - 5).alias("y"))
    return nearest_cell(pts, star.cells(spark, d), 2.0).withColumn("dist", F.round("dist", 6))


@query("join16_align_missing", with_views("cells", "ranges") + "SELECT cell_id FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM ranges)")
def join16(spark, d):
    return lk.missing_cells(star.cells(spark, d), star.ranges(spark, d))


@query("join16_align_or_fail", with_views("cells", "field") + "SELECT cell_id, t, salinity FROM field WHERE cell_id IN (SELECT cell_id FROM cells)")
def join16f(spark, d):
    """Raises when a part has no shipments; else the forcing comes back aligned."""
    return lk.align_or_fail(star.cells(spark, d), star.field(spark, d)).select("cell_id", "t", "salinity")


@query("join17_origin_dispatch", with_views("agents") + """SELECT agent_id, CASE WHEN origin = 1 AND behavior = 1 THEN 1.5 WHEN origin = 1 AND behavior = 3 THEN 2.0
  ELSE [1.0, 1.2, 0.8, 1.5, 1.0][behavior + 1] END::DOUBLE AS activity FROM agents""")
def join17(spark, d):
    return lk.origin_dispatch(star.agents(spark, d), {0: 1.0, 1: 1.2, 2: 0.8, 3: 1.5, 4: 1.0}, {1: 1.5, 3: 2.0}, "activity").select("agent_id", "activity")


SQL_GO = f"alive AND {sql_u('switch', 'agent_id')} < 0.1::DOUBLE"


@query("join18_switch_target", with_views("agents", "predators") + f"""SELECT agent_id, cell, alive, acc1 FROM predators UNION ALL
  SELECT (SELECT max(agent_id) FROM predators) + row_number() OVER (ORDER BY agent_id), cell, true, 0.0 FROM agents WHERE {SQL_GO}""")
def join18(spark, d):
    return lk.switch_population(star.agents(spark, d), star.predators(spark, d), 0.1, SEED)[1].select("agent_id", "cell", "alive", "acc1")


@query("join18_switch_source", with_views("agents") + f"SELECT agent_id, alive AND NOT ({SQL_GO}) AS alive FROM agents")
def join18s(spark, d):
    return lk.switch_population(star.agents(spark, d), star.predators(spark, d), 0.1, SEED)[0].select("agent_id", "alive")


@query("grf12_bounded_walk", with_views("agents", "edges") + """, hop AS (SELECT src, dst AS best FROM edges JOIN cells ON cell_id = dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist DESC, slot) = 1),
  nm AS (SELECT cell_id, 1 + level AS n_micro FROM cells), nb AS (SELECT src, list(dst ORDER BY slot) AS l FROM edges GROUP BY 1),
  s1 AS (SELECT agent_id, coalesce(best, cell) AS cell, CASE WHEN best IS NULL THEN 1.0 ELSE 1.0 - 1.0 / n_micro END::DOUBLE AS budget, (best IS NOT NULL)::INT::DOUBLE AS distance
    FROM agents LEFT JOIN hop ON src = cell LEFT JOIN nm ON cell_id = cell),
  s2 AS (SELECT agent_id, CASE WHEN budget > 0 AND l IS NOT NULL THEN l[least(floor(""" + sql_u('walk.1', 'agent_id') + """ * len(l)), len(l) - 1)::INT + 1] ELSE cell END AS cell,
    CASE WHEN budget > 0 AND l IS NOT NULL THEN budget - 1.0::DOUBLE / n_micro ELSE budget END AS budget, distance + (budget > 0 AND l IS NOT NULL)::INT AS distance
    FROM s1 LEFT JOIN nb ON src = cell LEFT JOIN nm ON cell_id = cell),
  s3 AS (SELECT agent_id, CASE WHEN budget > 0 AND best IS NOT NULL THEN best ELSE cell END AS walk_cell, CASE WHEN budget > 0 AND best IS NOT NULL THEN budget - 1.0::DOUBLE / n_micro ELSE budget END AS budget,
    distance + (budget > 0 AND best IS NOT NULL)::INT AS distance FROM s2 LEFT JOIN hop ON src = cell LEFT JOIN nm ON cell_id = cell)
  SELECT agent_id, walk_cell, round(budget, 6) AS budget, distance FROM s3""")
def grf12(spark, d):
    c = star.cells(spark, d).withColumn("n_micro", F.col("level") + 1)
    g = nb.adjacency(c, star.edges(spark, d), ("dist", "n_micro"))
    return (nb.bounded_walk(star.agents(spark, d).select("agent_id", "cell"), g, "dist", "directed", 3, SEED)
            .select("agent_id", "walk_cell", F.round("budget", 6).alias("budget"), "distance"))


@query("grf12_hops_per_cell", with_views("cells") + "SELECT cell_id, least(greatest(round_even(0.5::DOUBLE * 3600 / greatest(depth * 40, 1), 0), 1), 8)::INTEGER AS n_micro FROM cells")
def grf12h(spark, d):
    return star.cells(spark, d).select("cell_id", lk.edge_length_hops(0.5, 3600.0, F.col("depth") * 40, 8).alias("n_micro"))


@query("val11_degree", with_views("edges") + "SELECT src, count(*) AS degree FROM edges GROUP BY 1 HAVING count(*) > 5")
def val11(spark, d):
    from driftgrid.operators.checks import degree
    return degree(star.edges(spark, d), 5)
