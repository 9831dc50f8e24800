"""Queries for the scalar functions; floating results are rounded because libm differs in the last bits."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.functions import domain as dom
from driftgrid.functions import num
from driftgrid.functions.rand import hash_u, normal
from driftgrid.operators import energy, grid, layers
from driftgrid.plans import star
from driftgrid.plans.star import SEED, sql_u, with_views

A = with_views("agents")
BEHAVIOUR = [   # fixed values: P(behaviour | days to spawn, temperature)
    [[0.00, 0.20, 0.00, 0.80, 0.00], [0.00, 0.10, 0.20, 0.70, 0.00], [0.00, 0.00, 0.50, 0.50, 0.00], [0.00, 0.00, 0.60, 0.40, 0.00]],
    [[0.20, 0.20, 0.00, 0.60, 0.00], [0.00, 0.20, 0.30, 0.50, 0.00], [0.00, 0.00, 0.40, 0.40, 0.20], [0.00, 0.00, 0.70, 0.00, 0.30]],
    [[0.60, 0.10, 0.00, 0.30, 0.00], [0.40, 0.00, 0.20, 0.40, 0.00], [0.30, 0.00, 0.50, 0.20, 0.00], [0.20, 0.00, 0.80, 0.00, 0.00]],
]
BRANCHES = {"west": 0.51, "middle": 0.27, "east": 0.22}   # fixed values: discharge shares


def r6(c):
    return F.round(c, 6)


# acc1 with NaN and zero rows, so the guards are exercised on the whole table.
SQL_X = "CASE WHEN stage = 0 AND origin = 0 THEN 'NaN'::DOUBLE WHEN stage = 1 AND natal = 0 THEN 0.0::DOUBLE ELSE acc1 END"


def with_x(spark, d):
    x = (F.when((F.col("stage") == 0) & (F.col("origin") == 0), F.lit(float("nan")))
         .when((F.col("stage") == 1) & (F.col("natal") == 0), F.lit(0.0)).otherwise(F.col("acc1")))
    return star.agents(spark, d).withColumn("x", x).withColumn("m", F.col("mass_g"))


@query("fn1_conditionals", A + f"""SELECT agent_id, CASE WHEN NOT isnan(x) AND x > 0 THEN x ELSE -1.0::DOUBLE END AS cond, floor(x)::DOUBLE AS floor_,
  round(power(mass_g / 1000, 2.5), 6) AS pow_, round(exp(ed_kJ_g), 6) AS exp_, {sql_u('rand', 'agent_id')} AS rand_,
  round(sqrt(-2.0 * ln(1.0 - {sql_u('gasdev.r', 'agent_id')})) * cos(2.0 * pi() * {sql_u('gasdev.a', 'agent_id')}), 6) AS gasdev_
  FROM (SELECT *, {SQL_X} AS x FROM agents)""")
def fn1(spark, d):
    floor = F.when(F.isnan("x"), F.col("x")).otherwise(F.floor("x").cast("double"))
    return with_x(spark, d).select(
        "agent_id", num.cond("x", "x", -1.0).alias("cond"), floor.alias("floor_"),
        r6(F.pow(F.col("mass_g") / 1000, F.lit(2.5))).alias("pow_"), r6(F.exp("ed_kJ_g")).alias("exp_"),
        hash_u(SEED, "rand", "agent_id").alias("rand_"), r6(normal(SEED, "gasdev", "agent_id")).alias("gasdev_"))


@query("fn2_array_math", A + f"""SELECT agent_id,
  round(CASE WHEN isnan(x) OR x < 0 THEN 'NaN'::DOUBLE ELSE sqrt(x) END, 6) AS sqrt_, abs(x) AS abs_,
  round(CASE WHEN isnan(x) OR x < 0 THEN 'NaN'::DOUBLE WHEN x = 0 THEN '-Infinity'::DOUBLE ELSE ln(x) END, 6) AS log_,
  round(CASE WHEN isnan(x) OR x < 0 THEN 'NaN'::DOUBLE WHEN x = 0 THEN '-Infinity'::DOUBLE ELSE log10(x) END, 6) AS log10_,
  round(sin(m), 6) AS sin_, round(cos(m), 6) AS cos_, round(tan(stage), 6) AS tan_,
  CASE WHEN isnan(x) THEN x ELSE greatest(x, 100) END AS max_, CASE WHEN isnan(x) THEN x ELSE least(x, 100) END AS min_,
  CASE WHEN isnan(x) THEN x ELSE least(greatest(x, -10), 10) END AS clip_,
  CASE WHEN isnan(x) OR (x = 0 AND stage = 0) THEN 'NaN'::DOUBLE WHEN stage = 0 THEN CASE WHEN x > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END ELSE x / stage END AS div_,
  (((-steps) % 7) + 7) % 7 AS mod_, round(pi() + exp(1.0), 9) AS consts FROM (SELECT *, {SQL_X} AS x, mass_g AS m FROM agents)""")
def fn2(spark, d):
    stage = F.col("stage").cast("double")
    return with_x(spark, d).select(
        "agent_id", r6(num.sqrt("x")).alias("sqrt_"), F.abs("x").alias("abs_"), r6(num.log("x")).alias("log_"),
        r6(num.log10("x")).alias("log10_"), r6(F.sin("m")).alias("sin_"), r6(F.cos("m")).alias("cos_"), r6(F.tan("stage")).alias("tan_"),
        num.maximum("x", 100.0).alias("max_"), num.minimum("x", 100.0).alias("min_"), num.clip("x", -10.0, 10.0).alias("clip_"),
        num.divide("x", stage).alias("div_"), num.mod(-F.col("steps").cast("double"), 7.0).cast("int").alias("mod_"),
        F.round(F.pi() + F.e(), 9).alias("consts"))


SQL_RESP = "(0.00264::DOUBLE * power(greatest(mass_g, 1e-6), -0.217::DOUBLE) * exp(0.06818::DOUBLE * temp) * act * 13560.0::DOUBLE * mass_g / 24.0::DOUBLE)"
SQL_BIO = A + """, bio AS (SELECT *, 8.0::DOUBLE + steps / 40.0::DOUBLE AS temp, [1.0::DOUBLE, 1.2, 0.8, 1.5, 1.0][behavior + 1]::DOUBLE AS act FROM agents)
"""


def with_bio(spark, d):
    act = F.get(F.array(*[F.lit(x) for x in (1.0, 1.2, 0.8, 1.5, 1.0)]), F.col("behavior"))
    return star.agents(spark, d).withColumns({"temp": F.lit(8.0) + F.col("steps") / 40.0, "act": act})


@query("fn3_hourly_respiration", SQL_BIO + f"SELECT agent_id, round({SQL_RESP}, 6) AS joules FROM bio")
def fn3(spark, d):
    return with_bio(spark, d).select("agent_id", r6(dom.hourly_respiration(F.col("mass_g"), F.col("temp"), F.col("act"))).alias("joules"))


@query("fn4_update_energy", SQL_BIO + f"""SELECT agent_id, round(ed, 6) AS ed, round(mass, 6) AS mass, ed < 4.0 AS dead FROM (
  SELECT agent_id, mass, CASE WHEN mass > 0 THEN l / (mass * 1000.0::DOUBLE) ELSE 0 END AS ed FROM (
  SELECT agent_id, l, greatest(mass_g - (e - l) / 36000.0::DOUBLE, mass_g * 0.5::DOUBLE) AS mass FROM (
  SELECT agent_id, mass_g, e, greatest(e - resp * 1.25::DOUBLE, 0) AS l FROM (
  SELECT agent_id, mass_g, ed_kJ_g * 1000.0::DOUBLE * mass_g AS e, {SQL_RESP} AS resp FROM bio))))""")
def fn4(spark, d):
    out = energy.update_energy(with_bio(spark, d), F.col("temp"), F.col("act"), F.lit(1.25))
    return out.select("agent_id", r6("new_ed").alias("ed"), r6("new_mass").alias("mass"), "dead")


@query("fn5_salinity_cost", with_views("field") + """SELECT cell_id, t, round(1.0::DOUBLE + 0.3::DOUBLE * greatest(s - 10, 0) / 25.0::DOUBLE
  + 0.05::DOUBLE * greatest(10 - s, 0) / 10.0::DOUBLE, 9) AS cost
  FROM (SELECT cell_id, t, greatest(least(CASE WHEN isnan(temperature) THEN 10.0::DOUBLE ELSE salinity * 2 END, 35), 0) AS s FROM field)""")
def fn5(spark, d):
    sal = F.when(F.isnan("temperature"), F.lit(float("nan"))).otherwise(F.col("salinity") * 2)
    return star.field(spark, d).select("cell_id", "t", F.round(dom.salinity_cost(sal), 9).alias("cost"))


SQL_DO = "CASE WHEN isnan(temperature) THEN 'NaN'::DOUBLE ELSE oxygen END"
SQL_STATE = f"CASE WHEN isnan(temperature) THEN 0 WHEN oxygen < 3 THEN 2 WHEN oxygen < 5.5 THEN 1 ELSE 0 END"


def oxygen():
    return F.when(F.isnan("temperature"), F.lit(float("nan"))).otherwise(F.col("oxygen"))


@query("fn6_oxygen_state", with_views("field") + f"SELECT cell_id, t, {SQL_STATE} AS state FROM field")
def fn6(spark, d):
    return star.field(spark, d).select("cell_id", "t", dom.oxygen_state(oxygen(), 3.0, 5.5).alias("state"))


@query("fn7_surge_pause", with_views("field") + "SELECT cell_id, t, abs(u) > 0.08 AS hourly, abs(u) > 0.4 AS quarterly FROM field")
def fn7(spark, d):
    return star.field(spark, d).select("cell_id", "t", dom.surge_pause(F.col("u"), 0.08).alias("hourly"),
                                       dom.surge_pause(F.col("u"), 0.1, per_quarter_hour=True).alias("quarterly"))


@query("fn8_thermal_death", with_views("field") + """SELECT cell_id, t, NOT isnan(temperature) AND temperature >= 26 AS by_default,
  NOT isnan(temperature) AND temperature >= 24 AS acute FROM field""")
def fn8(spark, d):
    t = F.col("temperature")
    return star.field(spark, d).select("cell_id", "t", dom.thermal_death(t).alias("by_default"), dom.thermal_death(t, 24.0).alias("acute"))


def _sql_behaviour():
    rows = []
    for plane in BEHAVIOUR:
        for p in plane:
            total, cum = 0.0, []
            for x in p[:-1]:
                total += x
                cum.append(f"{total!r}::DOUBLE")
            rows.append("[" + ", ".join(cum) + "]")
    table = "[" + ", ".join(rows) + "]"
    te = "((temp >= 16)::INT + (temp >= 18)::INT + (temp >= 20)::INT)"
    ti = "((steps >= 360)::INT + (steps >= 720)::INT)"
    return A + f"""SELECT agent_id, len(list_filter({table}[{ti} * 4 + {te} + 1], lambda c: c <= u))::INTEGER AS behavior
  FROM (SELECT *, 10.0::DOUBLE + stage * 3.5::DOUBLE AS temp, {sql_u('behaviour', 'agent_id')} AS u FROM agents)"""


@query("fn9_pick_behaviour", _sql_behaviour())
def fn9(spark, d):
    temp = F.lit(10.0) + F.col("stage") * 3.5
    return energy.choose_behaviour(star.agents(spark, d), temp, F.col("steps"), BEHAVIOUR, SEED).select("agent_id", "behavior")


@query("fn10_behaviour_overrides", A + """SELECT agent_id, CASE WHEN b = 2 AND stage * 5 < 12 THEN 3 ELSE b END AS behavior FROM (
  SELECT *, CASE WHEN natal * 12 > 48 THEN 3 WHEN steps = 0 THEN 3 ELSE behavior END AS b FROM agents)""")
def fn10(spark, d):
    return star.agents(spark, d).select("agent_id", dom.behaviour_overrides(
        F.col("behavior"), F.col("steps"), F.col("natal") * 12, F.col("stage") * 5).alias("behavior"))


@query("fn11_estuary_overrides", with_views("agents", "field") + f"""SELECT agent_id, CASE WHEN alive AND state = 1 THEN 4 WHEN alive AND pause THEN 0 ELSE behavior END AS behavior,
  alive AND state <> 2 AS alive FROM (SELECT a.*, coalesce({SQL_STATE}, 0) AS state, coalesce(abs(u) > 0.3, false) AS pause
  FROM agents a LEFT JOIN field f ON a.cell = f.cell_id AND f.t = a.steps % 24)""")
def fn11(spark, d):
    f = star.field(spark, d).select(F.col("cell_id").alias("cell"), F.col("t").alias("k"), dom.oxygen_state(oxygen(), 3.0, 5.5).alias("state"),
                                    dom.surge_pause(F.col("u"), 0.3).alias("pause"))
    a = star.agents(spark, d).withColumn("k", F.col("steps") % 24).join(f, ["cell", "k"], "left")
    s = dom.estuary_overrides(F.col("behavior"), F.col("alive"), F.coalesce("pause", F.lit(False)), F.coalesce("state", F.lit(0)))
    return a.select("agent_id", s.alias("s")).select("agent_id", "s.behavior", "s.alive")


@query("fn12_flag_survival", A + f"SELECT agent_id, isnan(x) OR x >= 1 AS survives FROM (SELECT *, {SQL_X} AS x FROM agents)")
def fn12(spark, d):
    return with_x(spark, d).select("agent_id", dom.flag_survival(F.col("x")).alias("survives"))


@query("fn13_split_by_fraction", """SELECT o_orderkey, branch, o_totalprice * f AS share FROM orders,
  (VALUES ('west', 0.51::DOUBLE), ('middle', 0.27::DOUBLE), ('east', 0.22::DOUBLE)) b(branch, f)""")
def fn13(spark, d):
    return layers.split_by_fraction(star.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", BRANCHES).select("o_orderkey", "branch", "share")


@query("fn14_seasonal_discharge", """SELECT o_orderkey, round(400.0 + 1500.0 * exp(-power((dayofyear(o_orderdate) - 115) / 35.0::DOUBLE, 2)), 6) AS discharge FROM orders""")
def fn14(spark, d):
    return star.table(spark, d, "orders").select("o_orderkey", r6(dom.seasonal_discharge(F.col("o_orderdate"))).alias("discharge"))


@query("fn15_derived_layer", with_views("cells", "agents") + """SELECT cell_id, resource * 2 + coalesce(n, 0) / 4.0::DOUBLE - 7 AS quality
  FROM cells LEFT JOIN (SELECT cell, count(*) AS n FROM agents WHERE alive GROUP BY 1) ON cell = cell_id""")
def fn15(spark, d):
    base = star.cells(spark, d).select("cell_id", "resource")
    return layers.derived_layer(base, "quality", "resource * 2 + density / 4 - t", 7, star.agents(spark, d)).select("cell_id", "quality")


@query("fn16_set_affinity", A + "SELECT agent_id, CASE WHEN alive THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS spatial, 0.0::DOUBLE AS unknown FROM agents")
def fn16(spark, d):
    a = star.agents(spark, d).withColumns({"spatial": F.lit(0.0), "unknown": F.lit(0.0)})
    a = layers.set_affinity(a, "spatial", 0.8, "resource", ["resource"], F.col("alive"))
    return layers.set_affinity(a, "unknown", 0.5, "nowhere", ["resource"]).select("agent_id", "spatial", "unknown")


@query("fn17_distance_and_energy", with_views("cells", "agents") + """SELECT agent_id, round(2 * 6371000.0 * asin(sqrt(least(power(sin(dp / 2), 2) + cos(p1) * cos(p2) * power(sin(dl / 2), 2), 1))), 3) AS metres,
  round(CASE WHEN w > 4000 THEN 7598.0 + 0.527::DOUBLE * w ELSE 5763.0 + 0.986::DOUBLE * w END, 6) AS density,
  round(w * (0.00264::DOUBLE * 13560.0::DOUBLE / (CASE WHEN w > 4000 THEN 7598.0 + 0.527::DOUBLE * w ELSE 5763.0 + 0.986::DOUBLE * w END) * power(w, -0.217::DOUBLE)
   * exp(0.06818::DOUBLE * temp) * exp(0.0234::DOUBLE * 9.7::DOUBLE * power(w, 0.13::DOUBLE) * exp(0.0405::DOUBLE * temp)) / 24), 6) AS loss_g
  FROM (SELECT agent_id, mass_g * 1.4::DOUBLE AS w, 8.0::DOUBLE + steps / 60.0::DOUBLE AS temp, radians(50 + y / 100) AS p1, radians(55.0) AS p2,
   radians(55.0) - radians(50 + y / 100) AS dp, radians(21.0) - radians(20 + x / 100) AS dl FROM agents JOIN cells ON cell = cell_id)""")
def fn17(spark, d):
    w, temp = F.col("mass_g") * 1.4, F.lit(8.0) + F.col("steps") / 60.0
    c = star.cells(spark, d).select(F.col("cell_id").alias("cell"), (F.lit(50.0) + F.col("y") / 100).alias("lat"), (F.lit(20.0) + F.col("x") / 100).alias("lon"))
    return star.agents(spark, d).join(c, "cell").select(
        "agent_id", F.round(dom.haversine(F.col("lat"), F.col("lon"), F.lit(55.0), F.lit(21.0)), 3).alias("metres"),
        r6(dom.energy_density(w)).alias("density"), r6(dom.weight_respiration(w, temp)["mass_loss_g"]).alias("loss_g"))


@query("fn18_affine", with_views("cells") + "SELECT cell_id, round(2.0 * c + 0.5 * r + 10, 6)::DOUBLE AS px, round(-0.25 * c + 3.0 * r - 4, 6)::DOUBLE AS py FROM cells")
def fn18(spark, d):
    s = dom.affine(F.col("col"), F.col("row"), 2.0, 0.5, 10.0, -0.25, 3.0, -4.0)
    return star.cells(spark, d).select("cell_id", s.alias("s")).select("cell_id", r6("s.x").alias("px"), r6("s.y").alias("py"))


@query("spa4_depth_from_elevation", with_views("cells") + "SELECT cell_id, CASE WHEN region_id = -1 THEN 0 ELSE greatest(-(10 - depth), 0) END::DOUBLE AS depth FROM cells")
def spa4(spark, d):
    z = F.when(F.col("region_id") == -1, F.lit(float("nan"))).otherwise(F.lit(10.0) - F.col("depth"))
    return star.cells(spark, d).select("cell_id", dom.depth_from_elevation(z).alias("depth"))


@query("spa5_trust_region_mask", with_views("cells") + """SELECT cell_id, water OR region_id <> -1 AS water,
  CASE WHEN NOT water AND region_id <> -1 THEN greatest(depth - 3, 1) ELSE depth - 3 END AS depth FROM cells""")
def spa5(spark, d):
    return layers.trust_region_mask(star.cells(spark, d).withColumn("depth", F.col("depth") - 3)).select("cell_id", "water", "depth")


@query("spa8_negated_gradient", with_views("cells") + "SELECT cell_id, -depth / (SELECT max(depth) FROM cells) AS gradient FROM cells")
def spa8(spark, d):
    return layers.negated_gradient(star.cells(spark, d), "depth").select("cell_id", "gradient")


@query("agg19_layer_downsample", with_views("cells") + "SELECT r // 4 AS block_row, c // 5 AS block_col, avg(depth) AS depth, count(*) AS n_cells FROM cells GROUP BY 1, 2")
def agg19(spark, d):
    return layers.layer_downsample(star.cells(spark, d), "depth", 4, 5)


@query("gen20_haldane", with_views("genotypes") + "SELECT locus, agent_id, round(0.5 * (1 - exp(-2 * position_cm / 100)), 9) AS r FROM genotypes")
def gen20(spark, d):
    return star.genotypes(spark, d).select("locus", "agent_id", F.round(dom.haldane(F.col("position_cm")), 9).alias("r"))


@query("grf11_metric_scale", with_views("cells") + "SELECT cell_id, round(111320.0 * cos(radians(50 + y / 100)), 6) AS mx, 110540.0::DOUBLE AS my FROM cells")
def grf11(spark, d):
    return star.cells(spark, d).select("cell_id", dom.metric_scale(F.lit(50.0) + F.col("y") / 100).alias("s")).select("cell_id", r6("s.mx").alias("mx"), "s.my")


@query("grf7_hex_centres", with_views("cells") + """SELECT cell_id, r AS row_back, c AS col_back, round(x * 2.5, 6) AS x, round(y * 2.5, 6) AS y,
  (cell_id // 79) * 2 + (cell_id % 79 >= 40)::INT AS narrow_row, CASE WHEN cell_id % 79 >= 40 THEN cell_id % 79 - 40 ELSE cell_id % 79 END AS narrow_col FROM cells""")
def grf7(spark, d):
    c = star.cells(spark, d).select("cell_id")
    row, col = grid.row_col(F.col("cell_id"), star.WIDTH)
    nrow, ncol = grid.row_col(F.col("cell_id"), star.WIDTH, narrow=True)
    c = grid.hex_centres(c.select("cell_id", row.alias("row"), col.alias("col"), nrow.alias("narrow_row"), ncol.alias("narrow_col")), 2.5)
    return c.select("cell_id", F.col("row").alias("row_back"), F.col("col").alias("col_back"), r6("x").alias("x"), r6("y").alias("y"), "narrow_row", "narrow_col")


SQL_CUBE = """greatest(abs(q1 - q2), abs(r1 - r2), abs(q1 - q2 + r1 - r2))"""


@query("grf8_hex_distance", with_views("cells") + f"""SELECT cell_id, (SELECT 0) AS origin_cell, {SQL_CUBE} AS hops, {SQL_CUBE.replace('q1', 'p1').replace('q2', 'p2').replace('r1', 's1').replace('r2', 's2')} AS hops_odd_q
  FROM (SELECT cell_id, c - (r - r % 2) // 2 AS q1, r AS r1, 7 - (3 - 1) // 2 AS q2, 3 AS r2, c AS p1, r - (c - c % 2) // 2 AS s1, 7 AS p2, 3 - (7 - 1) // 2 AS s2 FROM cells)""")
def grf8(spark, d):
    c = star.cells(spark, d)
    r0, c0 = F.lit(3).cast("long"), F.lit(7).cast("long")
    return c.select("cell_id", F.lit(0).alias("origin_cell"), grid.hex_distance(F.col("row"), F.col("col"), r0, c0).alias("hops"),
                    grid.hex_distance(F.col("row"), F.col("col"), r0, c0, "odd-q").alias("hops_odd_q"))


@query("grf8_hex_vertices", with_views("cells") + """SELECT cell_id, k::INTEGER AS corner, round(x + cos(radians(60 * k - 30)), 6) AS vx, round(y + sin(radians(60 * k - 30)), 6) AS vy
  FROM cells, range(6) t(k)""")
def grf8v(spark, d):
    return grid.hex_vertices(star.cells(spark, d)).select("cell_id", "corner", r6("vx").alias("vx"), r6("vy").alias("vy"))


@query("grf6_hex_adjacency", with_views("adj") + "SELECT src, dst, slot FROM adj")
def grf6(spark, d):
    return grid.hex_adjacency(star.cells(spark, d), star.WIDTH)


@query("grf6_narrow_adjacency", with_views("cells") + """, nc AS (SELECT cell_id, (cell_id // 79) * 2 + (cell_id % 79 >= 40)::INT AS r,
   CASE WHEN cell_id % 79 >= 40 THEN cell_id % 79 - 40 ELSE cell_id % 79 END AS c FROM cells),
  offs(par, slot, dr, dc) AS (VALUES (0,0,-1,-1),(0,1,-1,0),(0,2,0,-1),(0,3,0,1),(0,4,1,-1),(0,5,1,0),(1,0,-1,0),(1,1,-1,1),(1,2,0,-1),(1,3,0,1),(1,4,1,0),(1,5,1,1))
  SELECT a.cell_id AS src, b.cell_id AS dst, slot FROM nc a JOIN offs o ON a.r % 2 = par JOIN nc b ON b.r = a.r + dr AND b.c = a.c + dc""")
def grf6n(spark, d):
    row, col = grid.row_col(F.col("cell_id"), star.WIDTH, narrow=True)
    return grid.hex_adjacency(star.cells(spark, d).select("cell_id", row.alias("row"), col.alias("col")), star.WIDTH, narrow=True)
