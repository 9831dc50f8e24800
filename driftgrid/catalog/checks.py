"""Queries for data-quality checks and run comparison."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.operators import checks as chk
from driftgrid.operators import compare as cmp
from driftgrid.plans import star
from driftgrid.plans.star import REGIONS, with_views


@query("val1_untagged", with_views("agents") + "SELECT agent_id, cell FROM agents WHERE alive AND cell >= 0 AND natal = -1")
def val1(spark, d):
    return chk.untagged(star.agents(spark, d)).select("agent_id", "cell")


@query("val2_unit_check", with_views("field") + "SELECT max(temperature) FILTER (NOT isnan(temperature)) AS finite_max, max(temperature) FILTER (NOT isnan(temperature)) > 25 AS suspect FROM field")
def val2(spark, d):
    return chk.unit_check(star.field(spark, d), "temperature", 25.0)


@query("val3_zone_table", with_views("cells") + """SELECT (SELECT max(region_id + 1) FROM cells)::BIGINT AS zones_needed, count(DISTINCT l_linenumber) AS zones_present,
  (SELECT max(region_id + 1) FROM cells) = count(DISTINCT l_linenumber) AS ok FROM lineitem""")
def val3(spark, d):
    z = star.table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("zone"))
    return chk.zone_table_check(star.cells(spark, d).withColumn("zone_raw", F.col("region_id") + 1), z)


@query("val4_distance_check", with_views("cells") + """, c AS (SELECT water, CASE WHEN region_id = -1 THEN 'NaN'::DOUBLE WHEN depth = 5 THEN 0 ELSE dist END AS d FROM cells)
  SELECT count(*) FILTER (water) AS n_water, count(*) FILTER (water AND isnan(d)) AS not_finite, max(d) FILTER (water AND NOT isnan(d)) AS max_dist,
  count(*) FILTER (water AND d = 0) AS n_sources, count(*) FILTER (water AND isnan(d)) = 0 AND max(d) FILTER (water AND NOT isnan(d)) > 0 AND count(*) FILTER (water AND d = 0) > 0 AS ok FROM c""")
def val4(spark, d):
    c = star.cells(spark, d).withColumn("dist", F.when(F.col("region_id") == -1, F.lit(float("nan"))).when(F.col("depth") == 5, F.lit(0.0)).otherwise(F.col("dist")))
    return chk.distance_check(c)


@query("val5_branch_topology", with_views("edges") + """, br(branch, region_id) AS (VALUES ('Upper', 0), ('Lagoon', 3), ('Delta', NULL)),
  cd AS (SELECT cell_id, region_id, coalesce(n, 0) AS deg FROM cells LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) ON src = cell_id),
  en AS (SELECT region_id, cell_id AS entry, deg FROM cd WHERE region_id >= 0 QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY deg = 0, cell_id) = 1)
  SELECT branch, problem FROM (SELECT branch, CASE WHEN br.region_id IS NULL THEN 'unknown region' WHEN entry IS NULL THEN 'no cells' WHEN deg = 0 THEN 'entry cell is dry' END AS problem
  FROM br LEFT JOIN en USING (region_id)) WHERE problem IS NOT NULL""")
def val5(spark, d):
    return chk.branch_topology(star.cells(spark, d), star.edges(spark, d), REGIONS, ["Upper", "Lagoon", "Delta"])


@query("val6_probabilities_sum", """SELECT l_orderkey, l_linenumber, round(l_discount + l_tax + 0.87::DOUBLE, 6) AS total FROM lineitem WHERE abs(l_discount + l_tax + 0.87::DOUBLE - 1.0) > 1e-6""")
def val6(spark, d):
    li = star.table(spark, d, "lineitem").withColumn("rest", F.lit(0.87))
    return chk.probabilities_sum(li, ["l_discount", "l_tax", "rest"]).select("l_orderkey", "l_linenumber", F.round("total", 6).alias("total"))


@query("val6_matrix_rows", """SELECT l_suppkey AS "row", round(sum(l_quantity / 15000), 9) AS total FROM lineitem GROUP BY 1 HAVING abs(sum(l_quantity / 15000) - 1) > 1e-6""")
def val6m(spark, d):
    m = star.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_quantity") / 15000).alias("value"))
    return chk.matrix_rows_sum(m).withColumn("total", F.round("total", 9))


@query("val7_dormant_gradient", with_views("agents", "cells") + """SELECT (SELECT bool_or(behavior IN (3, 4)) FROM agents) AS any_directed,
  (SELECT NOT bool_or(resource * 0 <> 0) FROM cells) AS all_zero, (SELECT bool_or(behavior IN (3, 4)) FROM agents) AND (SELECT NOT bool_or(resource * 0 <> 0) FROM cells) AS dormant""")
def val7(spark, d):
    return chk.dormant_gradient(star.agents(spark, d), star.cells(spark, d).withColumn("g", F.col("resource") * 0), "g")


@query("val8_tagged_dry", with_views("cells") + "SELECT region_id, count(*) AS n_dry FROM cells WHERE region_id <> -1 AND NOT water GROUP BY 1")
def val8(spark, d):
    return chk.tagged_dry(star.cells(spark, d))


@query("val9_barrier_ids", "SELECT l_orderkey, l_partkey - 10 AS hex_id FROM lineitem WHERE l_partkey - 10 < 0 OR l_partkey - 10 >= 1900")
def val9(spark, d):
    e = star.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") - 10).alias("hex_id"))
    return chk.barrier_ids(e, 1900)


@query("val10_monotone_flags", with_views("tracks") + """SELECT agent_id, "time" FROM (SELECT *, mass_g > 3100 AS flag, lag(mass_g > 3100) OVER (PARTITION BY agent_id ORDER BY "time") AS b FROM tracks) WHERE b AND NOT flag""")
def val10(spark, d):
    return chk.monotone_flags(star.tracks(spark, d).withColumn("flag", F.col("mass_g") > 3100), "flag").select("agent_id", "time")


SQL_AB = with_views("runs") + """, a AS (SELECT run_id AS pop, step, size, 1.0 + (step % 3) / 10.0::DOUBLE AS lam FROM runs), b AS (SELECT run_id AS pop, step + 1 AS step, size + (step % 4) AS size FROM runs),
  j AS (SELECT pop, step, a.size AS sa, b.size AS sb, lam AS la, lag(b.size) OVER (PARTITION BY pop ORDER BY step) AS p FROM a JOIN b USING (pop, step)),
  l AS (SELECT *, CASE WHEN p > 0 THEN sb / p ELSE 1.0 END AS lb FROM j),
  cc AS (SELECT pop, step, 'size' AS metric, sa::DOUBLE AS val_a, sb::DOUBLE AS val_b, CASE WHEN sa > 0 THEN abs(sa - sb) / sa WHEN sb > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS rel_error FROM l
   UNION ALL SELECT pop, step, 'lambda', la, lb, abs(la - lb) / la FROM l)
"""


def census_pair(spark, d):
    r = star.runs(spark, d).withColumnRenamed("run_id", "pop")
    a = r.withColumn("lambda", F.lit(1.0) + (F.col("step") % 3) / 10.0)
    return a, r.withColumn("size", F.col("size") + F.col("step") % 4).withColumn("step", F.col("step") + 1)


@query("cmp1_compare_census", SQL_AB + "SELECT pop, step, metric, round(val_a, 9) AS val_a, round(val_b, 9) AS val_b, round(rel_error, 9) AS rel_error FROM cc WHERE rel_error > 0")
def cmp1(spark, d):
    out = cmp.compare_census(*census_pair(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("val_a", "val_b", "rel_error")})


SQL_AG = with_views("tracks") + """, a AS (SELECT group_id AS pop, "time" AS step, ed_kJ_g * 1.0123456789::DOUBLE AS ed, mass_g * 1.0123456789::DOUBLE AS mass FROM tracks), b AS (SELECT pop, step, ed * 1.02::DOUBLE + 0.1 AS ed, mass - step AS mass FROM a),
  s AS (SELECT pop, step, count(*) AS n, avg(ed) AS ed, avg(mass) AS m, stddev_pop(ed) AS sd FROM a GROUP BY 1, 2), u AS (SELECT pop, step, count(*) AS n, avg(ed) AS ed, avg(mass) AS m, stddev_pop(ed) AS sd FROM b GROUP BY 1, 2),
  ca AS (SELECT s.pop, s.step, 'mean_ed' AS metric, s.ed AS val_a, u.ed AS val_b, abs(s.ed - u.ed) / s.ed AS rel_error FROM s JOIN u USING (pop, step)
   UNION ALL SELECT s.pop, s.step, 'mean_mass', s.m, u.m, abs(s.m - u.m) / s.m FROM s JOIN u USING (pop, step)
   UNION ALL SELECT s.pop, s.step, 'std_ed', s.sd, u.sd, abs(s.sd - u.sd) / s.sd FROM s JOIN u USING (pop, step) WHERE s.n > 1)
"""


def agent_pair(spark, d):
    a = star.tracks(spark, d).select(F.col("group_id").alias("pop"), F.col("time").alias("step"), (F.col("ed_kJ_g") * 1.0123456789).alias("ed"), (F.col("mass_g") * 1.0123456789).alias("mass"))
    return a, a.withColumns({"ed": F.col("ed") * 1.02 + 0.1, "mass": F.col("mass") - F.col("step")})


@query("cmp2_compare_agents", SQL_AG + "SELECT pop, step, metric, round(val_a, 5) AS val_a, round(val_b, 5) AS val_b, round(rel_error, 7) AS rel_error FROM ca WHERE rel_error > 1e-9")
def cmp2(spark, d):
    out = cmp.compare_agents(*agent_pair(spark, d)).filter("rel_error > 1e-9")
    return out.withColumns({"val_a": F.round("val_a", 5), "val_b": F.round("val_b", 5), "rel_error": F.round("rel_error", 7)})


@query("cmp3_spatial_jsd", with_views("tracks") + """, a AS (SELECT group_id, cell // 20 AS cell, count(*) AS n FROM tracks WHERE origin = 0 GROUP BY 1, 2), b AS (SELECT group_id - 1 AS group_id, cell // 20 AS cell, count(*) AS n FROM tracks WHERE origin = 1 GROUP BY 1, 2),
  p AS (SELECT group_id, cell, n / sum(n) OVER (PARTITION BY group_id) AS p FROM a), q AS (SELECT group_id, cell, n / sum(n) OVER (PARTITION BY group_id) AS q FROM b),
  j AS (SELECT group_id, cell, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q USING (group_id, cell) WHERE group_id IN (SELECT group_id FROM p) AND group_id IN (SELECT group_id FROM q))
  SELECT group_id, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 9) AS jsd FROM j GROUP BY 1""")
def cmp3(spark, d):
    t = star.tracks(spark, d).withColumn("cell", F.expr("cell div 20"))
    a, b = t.filter("origin = 0"), t.filter("origin = 1").withColumn("group_id", F.col("group_id") - 1)
    return cmp.spatial_jsd(a, b, ("group_id",)).withColumn("jsd", F.round("jsd", 9))


@query("cmp4_verdict", SQL_AB + SQL_AG.replace("WITH ", ", ", 1).replace(", a AS (SELECT group_id", ", a2 AS (SELECT group_id").replace("mass FROM a)", "mass FROM a2)")
       .replace("FROM a GROUP", "FROM a2 GROUP").replace(" b AS (SELECT pop, step, ed", " b2 AS (SELECT pop, step, ed").replace("FROM b GROUP", "FROM b2 GROUP") +
       """SELECT CASE WHEN (SELECT bool_or(metric = 'size' AND rel_error > 0.05 AND abs(val_a - val_b) > 10) FROM cc) OR (SELECT max(rel_error) FROM ca) > 0.15 THEN 'FAIL'
  WHEN (SELECT max(rel_error) FROM ca) > 0.05 THEN 'WARN' ELSE 'PASS' END AS verdict""")
def cmp4(spark, d):
    return cmp.verdict(cmp.compare_census(*census_pair(spark, d)), cmp.compare_agents(*agent_pair(spark, d)))


@query("cmp5_energy_loss", with_views("tracks") + """, e AS (SELECT agent_id, origin, arg_min(ed_kJ_g, "time") AS f, arg_max(ed_kJ_g, "time") AS l, bool_and(alive) AS lived FROM tracks GROUP BY 1, 2)
  SELECT origin, count(*) AS n, round(avg((f - l) / f), 9) AS mean_loss, round(avg((NOT lived)::INT), 9) AS mortality FROM e GROUP BY 1""")
def cmp5(spark, d):
    return cmp.energy_loss(star.tracks(spark, d), "origin").withColumns({"mean_loss": F.round("mean_loss", 9), "mortality": F.round("mortality", 9)})
