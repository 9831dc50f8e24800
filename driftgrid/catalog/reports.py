"""Queries for reports, tallies and summaries."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.operators import reports as rep
from driftgrid.plans import star
from driftgrid.plans.star import REGIONS, SEED, sql_u, with_views

T = with_views("tracks")
BEHAVIOURS = ["hold", "random", "refuge", "upstream", "downstream"]


def r(c, n=6):
    return F.round(F.col(c), n).alias(c)


SQL_SUMMARY = """SELECT {keys}count(*) FILTER (alive) AS n_alive, count(*) FILTER (arrived) AS n_arrived,
  round(coalesce(avg(ed_kJ_g) FILTER (alive), 0), 9) AS mean_ed, round(coalesce(avg(mass_g) FILTER (alive), 0), 7) AS mean_mass,
  """ + ", ".join(f"count(*) FILTER (alive AND behavior = {b}) AS behavior_{b}" for b in range(5)) + " FROM tracks"


@query("agg1_step_summary", T + SQL_SUMMARY.format(keys='"time", ') + ' GROUP BY "time"')
def agg1(spark, d):
    out = rep.step_summary(star.tracks(spark, d))
    return out.withColumns({"mean_ed": F.round("mean_ed", 9), "mean_mass": F.round("mean_mass", 7)})


@query("agg2_productivity", with_views("runs") + """SELECT run_id, step, size, round_even(CASE WHEN p IS NULL THEN (size > 0)::INT WHEN p = 0 THEN 0 ELSE size / p END, 4)::DOUBLE AS lambda
  FROM (SELECT *, lag(size) OVER (PARTITION BY run_id ORDER BY step) AS p FROM runs)""")
def agg2(spark, d):
    return rep.productivity(star.runs(spark, d), ["run_id"], "step", "size").select("run_id", "step", "size", "lambda")


@query("agg3_demographics", T + """SELECT "time", count(*) FILTER (alive) AS n_alive, count(*) FILTER (NOT alive) AS n_dead, count(*) AS n_total,
  round(coalesce(avg(mass_g) FILTER (alive), 0), 7) AS mean_mass, round(coalesce(avg(ed_kJ_g) FILTER (alive), 0), 9) AS mean_ed FROM tracks GROUP BY 1""")
def agg3(spark, d):
    out = rep.demographics(star.tracks(spark, d))
    return out.withColumns({"mean_ed": F.round("mean_ed", 9), "mean_mass": F.round("mean_mass", 7)})


@query("agg4_census", T + """SELECT "time", n_alive, n_dead, n_total, category, coalesce(n, 0) AS n FROM
  (SELECT "time", count(*) FILTER (alive) AS n_alive, count(*) FILTER (NOT alive) AS n_dead, count(*) AS n_total FROM tracks GROUP BY 1)
  CROSS JOIN (VALUES (0, 'hold'), (1, 'random'), (2, 'refuge'), (3, 'upstream'), (4, 'downstream')) c(behavior, category)
  LEFT JOIN (SELECT "time", behavior, count(*) AS n FROM tracks WHERE alive GROUP BY 1, 2) USING ("time", behavior)""")
def agg4(spark, d):
    return rep.census(star.tracks(spark, d), "behavior", BEHAVIOURS)


@query("agg4_census_cube", with_views("agents") + """SELECT stage, origin, nation, count(*) AS n, grouping_id(stage, origin, nation)::BIGINT AS level
  FROM agents WHERE alive GROUP BY CUBE (stage, origin, nation)""")
def agg4c(spark, d):
    return rep.census_cube(star.agents(spark, d), ["stage", "origin", "nation"])


@query("agg5_dispersal", with_views("tracks", "cells") + """, p AS (SELECT "time", agent_id, x, y FROM tracks JOIN cells ON cell = cell_id),
  f AS (SELECT "time", sqrt(power(x - first_value(x) OVER w, 2) + power(y - first_value(y) OVER w, 2)) AS d FROM p WINDOW w AS (PARTITION BY agent_id ORDER BY "time"))
  SELECT "time", round(avg(d), 6) AS mean_displacement, round(max(d), 6) AS max_displacement, round(quantile_cont(d, 0.5), 6) AS median_displacement FROM f GROUP BY 1""")
def agg5(spark, d):
    return rep.dispersal(star.tracks(spark, d), star.cells(spark, d)).select("time", r("mean_displacement"), r("max_displacement"), r("median_displacement"))


@query("agg6_genetic_report", with_views("genotypes") + """SELECT count(*) AS n_agents, round_even(avg((a0 <> a1)::INT), 4) AS heterozygosity,
  round_even(avg((a0 = 0)::INT + (a1 = 0)::INT) / 2, 4) AS freq_allele_0, round_even(avg((a0 = 1)::INT + (a1 = 1)::INT) / 2, 4) AS freq_allele_1,
  round_even(avg((a0 = 2)::INT + (a1 = 2)::INT) / 2, 4) AS freq_allele_2, 0.0::DOUBLE AS freq_allele_3 FROM genotypes WHERE locus = 'A'""")
def agg6(spark, d):
    return rep.genetic_report(star.genotypes(spark, d), "A", 4)


@query("agg7_occupancy", with_views("tracks", "cells") + """SELECT cell_id, coalesce(n, 0) AS steps FROM cells
  LEFT JOIN (SELECT cell, count(DISTINCT "time") AS n FROM tracks WHERE alive GROUP BY 1) ON cell = cell_id""")
def agg7(spark, d):
    return rep.occupancy(star.tracks(spark, d), star.cells(spark, d))


@query("agg8_density", with_views("tracks", "cells") + """SELECT cell_id, coalesce(n, 0) AS n FROM cells
  LEFT JOIN (SELECT cell, count(*) AS n FROM tracks WHERE alive GROUP BY 1) ON cell = cell_id""")
def agg8(spark, d):
    return rep.density(star.tracks(spark, d), star.cells(spark, d))


@query("agg8_density_by_step", T + 'SELECT "time", cell AS cell_id, count(*) AS n FROM tracks WHERE alive GROUP BY 1, 2')
def agg8s(spark, d):
    return rep.density_by_step(star.tracks(spark, d))


@query("agg9_flux", with_views("tracks", "cells") + """, m AS (SELECT cell, old FROM (SELECT *, lag(cell) OVER (PARTITION BY agent_id ORDER BY "time") AS old FROM tracks)
   WHERE alive AND old IS NOT NULL AND old <> cell)
  SELECT cell_id, coalesce(s, 0)::BIGINT AS net FROM cells LEFT JOIN (SELECT k, sum(dd) AS s FROM (SELECT cell AS k, 1 AS dd FROM m UNION ALL SELECT old, -1 FROM m) GROUP BY 1) ON k = cell_id""")
def agg9(spark, d):
    return rep.flux(star.tracks(spark, d), star.cells(spark, d))


SQL_DEATHS = T + """, ev AS (SELECT cell AS cell_id, "time" FROM tracks WHERE NOT alive)
"""


@query("agg10_barrier_tally", SQL_DEATHS + """SELECT cell_id, count(*) AS deaths, count(DISTINCT "time") AS steps_with_deaths FROM ev GROUP BY 1""")
def agg10(spark, d):
    ev = star.tracks(spark, d).select(F.col("cell").alias("cell_id"), "time", (~F.col("alive")).alias("died"))
    return rep.barrier_tally(ev).join(rep.barrier_tally(ev, True).withColumnRenamed("deaths", "steps_with_deaths"), "cell_id")


@query("agg12_range_summary", with_views("ranges") + """SELECT count(*) AS n_owners, coalesce(sum(n), 0)::BIGINT AS n_cells, coalesce(avg(n), 0) AS mean_size, coalesce(max(n), 0) AS max_size
  FROM (SELECT owner, count(*) AS n FROM ranges GROUP BY 1)""")
def agg12(spark, d):
    return rep.range_summary(star.ranges(spark, d))


@query("agg13_homozygosity", with_views("genotypes") + """SELECT agent_id, avg((a0 = a1)::INT) AS homozygosity, max(CASE WHEN locus = 'B' THEN (a0 = a1)::INT END)::DOUBLE AS at_b FROM genotypes GROUP BY 1""")
def agg13(spark, d):
    g = star.genotypes(spark, d)
    return rep.homozygosity(g).join(rep.homozygosity(g, "B").withColumnRenamed("homozygosity", "at_b"), "agent_id")


@query("agg14_region_thresholds", with_views("cells") + """SELECT region_id, round(quantile_cont(dist, 0.75) FILTER (water), 6) AS threshold FROM cells WHERE region_id >= 0 GROUP BY 1""")
def agg14(spark, d):
    return rep.region_thresholds(star.cells(spark, d)).select("region_id", r("threshold"))


@query("agg15_density_survival", with_views("agents") + f"""SELECT agent_id, {sql_u('survival', 'agent_id')} < least(rate * (1 + 0.5::DOUBLE * greatest(count(*) OVER (PARTITION BY cell) - 1.0::DOUBLE, 0)), 1) AS died
  FROM (SELECT *, [0.1::DOUBLE, 0.3::DOUBLE, 0.0::DOUBLE, 0.05::DOUBLE][stage + 1] AS rate FROM agents WHERE alive)""")
def agg15(spark, d):
    a = star.agents(spark, d).filter("alive")
    return rep.density_survival(a, {"egg": 0.1, "fry": 0.3, "spawner": 0.05}, "stage", ["egg", "fry", "adult", "spawner"], 0.5, SEED).select("agent_id", "died")


@query("agg16_cell_diagnostics", with_views("edges") + """SELECT c.cell_id, CASE WHEN region_id < 0 THEN 'Land' ELSE ['Upper','Middle','Lower','Lagoon','Coast'][region_id + 1] END AS region,
  level, area, depth, coalesce(n, 0) AS degree, coalesce(s, 0) AS same_level, coalesce(n - s, 0) AS cross_level FROM cells c LEFT JOIN
  (SELECT src, count(*) AS n, count(*) FILTER (a.level = b.level) AS s FROM edges JOIN cells a ON src = a.cell_id JOIN cells b ON dst = b.cell_id GROUP BY 1) ON src = c.cell_id""")
def agg16(spark, d):
    return rep.cell_diagnostics(star.cells(spark, d), star.edges(spark, d), REGIONS)


@query("agg17_cross_region_links", with_views("edges") + """SELECT least(a.region_id, b.region_id) AS region_a, greatest(a.region_id, b.region_id) AS region_b, count(*) AS links
  FROM edges JOIN cells a ON src = a.cell_id JOIN cells b ON dst = b.cell_id WHERE a.region_id >= 0 AND b.region_id >= 0 AND a.region_id <> b.region_id GROUP BY 1, 2""")
def agg17(spark, d):
    return rep.cross_region_links(star.cells(spark, d), star.edges(spark, d))


@query("agg18_ensemble_summary", with_views("runs") + """SELECT step, count(*) AS n_runs, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS sd, min(size) AS low, max(size) AS high,
  quantile_cont(size::DOUBLE, 0.5) AS median FROM runs GROUP BY 1""")
def agg18(spark, d):
    return rep.ensemble_summary(star.runs(spark, d)).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("agg18_final_state", with_views("runs") + "SELECT run_id, step, size, n_arrived FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) = 1")
def agg18f(spark, d):
    return rep.final_state(star.runs(spark, d))


@query("agg20_nan_fraction", with_views("field") + "SELECT t, round(avg(isnan(temperature)::INT), 9) AS nan_fraction, avg(isnan(temperature)::INT) > 0.02 AS alarm FROM field GROUP BY 1")
def agg20(spark, d):
    return rep.nan_fraction(star.field(spark, d), "temperature", alarm=0.02).withColumn("nan_fraction", F.round("nan_fraction", 9))


@query("agg21_field_range", with_views("field") + " UNION ALL ".join(
    f"SELECT '{c}' AS var, min({c}) FILTER (NOT isnan({c})) AS low, max({c}) FILTER (NOT isnan({c})) AS high, round(avg({c}) FILTER (NOT isnan({c})), 6) AS mean FROM field"
    for c in ("temperature", "salinity", "u")))
def agg21(spark, d):
    return rep.field_range(star.field(spark, d), ["temperature", "salinity", "u"]).withColumn("mean", F.round("mean", 6))


@query("udf3_replicates", with_views("tracks") + SQL_SUMMARY.format(keys='origin AS run_id, "time", ') + ' GROUP BY origin, "time"')
def udf3(spark, d):
    """One job over every replicate: the run id is a grouping key."""
    t = star.tracks(spark, d).withColumnRenamed("origin", "run_id")
    out = rep.step_summary(t, keys=("run_id", "time"))
    return out.withColumns({"mean_ed": F.round("mean_ed", 9), "mean_mass": F.round("mean_mass", 7)})


@query("gen6_bernoulli", with_views("agents") + f"""SELECT agent_id, {sql_u('release', 'agent_id')} < 0.2::DOUBLE AS released,
  {sql_u('predation', 'agent_id')} > power(CASE behavior WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.99::DOUBLE END, 1 / 24.0::DOUBLE) AS died FROM agents""")
def gen6(spark, d):
    from driftgrid.operators.generation import bernoulli, survival_deaths
    a = star.agents(spark, d)
    a = bernoulli(a, "released", 0.2, SEED, "release")
    return survival_deaths(a, "behavior", {0: 0.9, 1: 0.5}, 0.99, SEED).select("agent_id", "released", "died")
