"""Queries for per-individual time series and set operations."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.operators import reports as rep
from driftgrid.operators import sets
from driftgrid.operators import tracks as trk
from driftgrid.plans import star
from driftgrid.plans.star import with_views

T = with_views("tracks")
W = 'WINDOW w AS (PARTITION BY agent_id ORDER BY "time" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'


@query("win1_rolling_mean3", T + """, act AS (SELECT agent_id, "time", (mass_g + coalesce(lag(mass_g) OVER v, 15.0) + coalesce(lag(mass_g, 2) OVER v, 15.0)) / 3.0 AS m
   FROM tracks WHERE alive AND NOT arrived WINDOW v AS (PARTITION BY agent_id ORDER BY "time"))
  SELECT agent_id, "time", round(coalesce(last_value(m IGNORE NULLS) OVER w, 15.0), 6)::DOUBLE AS mean3 FROM tracks LEFT JOIN act USING (agent_id, "time") """ + W)
def win1(spark, d):
    return trk.rolling_mean3(star.tracks(spark, d), "mass_g").select("agent_id", "time", F.round("mean3", 6).alias("mean3"))


@query("win2_residence_counters", T + """, a AS (SELECT *, alive AND NOT arrived AS act, behavior = 2 AS s, sum((alive AND NOT arrived)::INT) OVER w AS rn FROM tracks """ + W + """),
  b AS (SELECT *, last_value(CASE WHEN act THEN s END IGNORE NULLS) OVER w AS st, max(CASE WHEN act AND s THEN rn END) OVER w AS li, max(CASE WHEN act AND NOT s THEN rn END) OVER w AS lo FROM a """ + W + """)
  SELECT agent_id, "time", (CASE WHEN st THEN rn - coalesce(lo, 0) ELSE 0 END)::BIGINT AS hours_in, (CASE WHEN st THEN 0 WHEN li IS NULL THEN 999 + rn ELSE rn - li END)::BIGINT AS steps_since FROM b""")
def win2(spark, d):
    return trk.residence_counters(star.tracks(spark, d), F.col("behavior") == 2).select("agent_id", "time", "hours_in", "steps_since")


@query("win3_step_timers", T + f"""SELECT agent_id, "time", n::BIGINT AS steps, greatest(40 - n, 0)::BIGINT AS "left" FROM (
  SELECT *, sum((alive AND NOT arrived)::INT) OVER w AS n FROM tracks {W})""")
def win3(spark, d):
    return trk.step_timers(star.tracks(spark, d), 40).select("agent_id", "time", "steps", "left")


@query("win4_field_rate", with_views("field") + "SELECT cell_id, t, salinity, round(coalesce(salinity - lag(salinity) OVER (PARTITION BY cell_id ORDER BY t), 0), 9) AS rate FROM field")
def win4(spark, d):
    return trk.field_rate(star.field(spark, d), "salinity").select("cell_id", "t", "salinity", F.round("rate", 9).alias("rate"))


TR = with_views("tracks", "cells") + ', r AS (SELECT t.*, region_id, dist FROM tracks t LEFT JOIN cells ON cell = cell_id)\n'


@query("win5_first_touch", TR + """SELECT agent_id, region_id, "time" FROM r WHERE alive AND region_id IN (1, 3) QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY "time") = 1""")
def win5(spark, d):
    return trk.first_touch(star.tracks(spark, d), star.cells(spark, d), [1, 3])


@query("win5_first_touch_rows", TR + f"""SELECT agent_id, "time", coalesce(first_value(CASE WHEN alive AND region_id IN (1, 3) THEN region_id END IGNORE NULLS) OVER w, -1) AS tag FROM r {W}""")
def win5r(spark, d):
    return trk.first_touch_rows(star.tracks(spark, d), star.cells(spark, d), [1, 3]).select("agent_id", "time", "tag")


@query("win6_ever_in", TR + f"""SELECT agent_id, "time", bool_or(alive AND coalesce(region_id IN (0, 4), false)) OVER w AS ever_in FROM r {W}""")
def win6(spark, d):
    return trk.ever_in(star.tracks(spark, d), star.cells(spark, d), [0, 4]).select("agent_id", "time", "ever_in")


SQL_NATAL = """, nat AS (SELECT agent_id, coalesce(region_id, -1) AS natal FROM r QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY "time") = 1)
"""


@query("win7_arrival", TR + SQL_NATAL + f""", thr AS (SELECT region_id, quantile_cont(dist, 0.75) FILTER (water) AS threshold FROM cells WHERE region_id >= 0 GROUP BY 1),
  s AS (SELECT *, bool_or(alive AND coalesce(region_id IN (0, 1, 4), false)) OVER w AS sea FROM r {W})
  SELECT s.agent_id, "time", cell FROM s JOIN nat ON nat.agent_id = s.agent_id JOIN thr ON thr.region_id = natal
  WHERE alive AND sea AND s.region_id = natal AND dist >= threshold - 1e-9 QUALIFY row_number() OVER (PARTITION BY s.agent_id ORDER BY "time") = 1""")
def win7(spark, d):
    t, c = star.tracks(spark, d), star.cells(spark, d)
    thr = rep.region_thresholds(c).withColumn("threshold", F.col("threshold") - 1e-9)
    return trk.arrival(t, c, trk.natal_region(t, c), thr, [0, 1, 4])


@query("win8_trips", with_views("tracks", "cells") + """, tk AS (SELECT agent_id FROM
   (SELECT * FROM tracks QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY "time") = 1) WHERE alive),
  p AS (SELECT agent_id, x, y, "time" - (SELECT max("time") FROM tracks) + 39 AS t FROM tracks JOIN cells ON cell = cell_id
   WHERE alive AND "time" > (SELECT max("time") FROM tracks) - 40 AND agent_id IN (SELECT agent_id FROM tk)),
  g AS (SELECT agent_id, list(x ORDER BY t) AS xs, list(y ORDER BY t) AS ys, list(t ORDER BY t) AS ts FROM p GROUP BY 1),
  lb AS (SELECT agent_id, behavior FROM tracks WHERE alive QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY "time" DESC) = 1)
  SELECT agent_id, len(xs)::INTEGER AS points, round(xs[1], 6) AS x0, round(xs[-1], 6) AS x1, round(ys[-1], 6) AS y1, ts[1]::INTEGER AS t0, ts[-1]::INTEGER AS t1, behavior
  FROM g JOIN lb USING (agent_id) WHERE len(xs) >= 2 AND (len(list_distinct(xs)) > 1 OR len(list_distinct(ys)) > 1)""")
def win8(spark, d):
    t = trk.trips(star.tracks(spark, d), star.cells(spark, d))
    first, last = F.col("path")[0], F.element_at("path", -1)
    return t.select("agent_id", F.size("path").alias("points"), F.round(first["x"], 6).alias("x0"), F.round(last["x"], 6).alias("x1"),
                    F.round(last["y"], 6).alias("y1"), first["t"].cast("int").alias("t0"), last["t"].cast("int").alias("t1"), "behavior")


@query("win9_assign_ids", """SELECT l_orderkey, l_linenumber, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS agent_id
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def win9(spark, d):
    rows = star.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    next_id = star.table(spark, d, "customer").agg(F.max("c_custkey") + 1).scalar()
    return (trk.assign_ids(rows, "l_orderkey", next_id, ties=["l_linenumber"])
            .select("l_orderkey", "l_linenumber", "agent_id"))


@query("win10_natal_region", TR + SQL_NATAL + "SELECT agent_id, natal FROM nat")
def win10(spark, d):
    return trk.natal_region(star.tracks(spark, d), star.cells(spark, d))


@query("top1_rank_frontier", with_views("edges", "ranges") + """, f AS (SELECT DISTINCT owner AS agent_id, dst AS cell_id FROM ranges JOIN edges ON src = ranges.cell_id
   WHERE dst NOT IN (SELECT cell_id FROM ranges))
  SELECT agent_id, f.cell_id, resource AS worth, row_number() OVER (PARTITION BY agent_id ORDER BY resource DESC, f.cell_id) AS rank
  FROM f JOIN cells USING (cell_id) WHERE resource >= 2 QUALIFY rank <= 5""")
def top1(spark, d):
    r, e = star.ranges(spark, d), star.edges(spark, d)
    frontier = (r.select(F.col("cell_id").alias("src"), F.col("owner").alias("agent_id")).join(e, "src")
                .select("agent_id", F.col("dst").alias("cell_id")).join(r.select("cell_id"), "cell_id", "left_anti"))
    return sets.rank_frontier(frontier, star.cells(spark, d), "resource", 2.0, 5)


@query("set1_add_agents", with_views("agents") + """SELECT agent_id, cell, mass_g, ed_kJ_g, alive, arrived, origin, natal, group_id, acc1, stage, sea_age FROM agents
  UNION ALL SELECT 100000000 + s_suppkey, s_nationkey, 3500.0, 6.5, true, false, 0, -1, -1, 0.0, 0, -1 FROM supplier""")
def set1(spark, d):
    a = star.agents(spark, d)
    new = star.table(spark, d, "supplier").select((F.lit(100000000) + F.col("s_suppkey")).alias("agent_id"), F.col("s_nationkey").alias("cell"))
    return sets.add_agents(a, new).select("agent_id", "cell", "mass_g", "ed_kJ_g", "alive", "arrived", "origin", "natal", "group_id", "acc1", "stage", "sea_age")


@query("set2_shared_cells", with_views("predators", "prey") + "SELECT cell FROM predators WHERE alive INTERSECT SELECT cell FROM prey WHERE alive")
def set2(spark, d):
    return sets.shared_cells(star.predators(spark, d), star.prey(spark, d))


@query("set3_claim_first", "SELECT l_partkey AS cell_id, l_linenumber AS region FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY 8 - l_linenumber, l_linenumber) = 1")
def set3(spark, d):
    claims = star.table(spark, d, "lineitem").select(F.col("l_partkey").alias("cell_id"), F.col("l_linenumber").alias("region"), (8 - F.col("l_linenumber")).alias("priority"))
    return sets.claim_first(claims)


@query("set4_unmatched", with_views("cells", "ranges") + "SELECT cell_id, 'Coast' AS region FROM cells WHERE water AND cell_id NOT IN (SELECT cell_id FROM ranges)")
def set4(spark, d):
    return sets.unmatched(star.cells(spark, d), star.ranges(spark, d), "Coast")
