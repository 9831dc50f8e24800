"""Queries for masks, filters and triggers."""

from driftgrid.catalog.base import query
from driftgrid.operators import filters as flt
from driftgrid.operators import grid
from driftgrid.plans import star
from driftgrid.plans.star import REGIONS, SEED, sql_u, with_views

STAGES = {"stage": ["egg", "fry", "adult", "spawner"], "origin": ["wild", "reared"]}


@query("flt1_active", with_views("tracks") + 'SELECT "time", agent_id, cell FROM tracks WHERE alive AND NOT arrived')
def flt1(spark, d):
    return flt.active(star.tracks(spark, d)).select("time", "agent_id", "cell")


@query("flt2_by_traits", with_views("agents") + "SELECT agent_id, stage, origin FROM agents WHERE stage IN (1, 2) AND origin = 0")
def flt2(spark, d):
    return flt.filter_by_traits(star.agents(spark, d), STAGES, stage=["fry", 2], origin="wild").select("agent_id", "stage", "origin")


@query("flt3_by_combo", with_views("agents") + "SELECT agent_id FROM agents WHERE [1,0,0,1,1,0,0,1][stage * 2 + origin + 1] = 1")
def flt3(spark, d):
    return flt.filter_by_combo(star.agents(spark, d), ["stage", "origin"], [4, 2], [1, 0, 0, 1, 1, 0, 0, 1]).select("agent_id")


@query("flt4_triggers", with_views("tracks") + f"""SELECT "time", agent_id, "time" = 100 AS once, "time" = 99 AS once_external,
  "time" >= 5 AND ("time" - 5) % 24 = 0 AS periodic, "time" >= 48 AND "time" < 96 AS in_window,
  {sql_u('trigger', '"time"')} < 0.25::DOUBLE AS random FROM tracks
  WHERE "time" = 100 OR "time" = 99 OR ("time" >= 5 AND ("time" - 5) % 24 = 0) OR ("time" >= 48 AND "time" < 96) OR {sql_u('trigger', '"time"')} < 0.25::DOUBLE""")
def flt4(spark, d):
    marks = {"once": flt.trigger_once("time", 100), "once_external": flt.trigger_once_external("time", 100),
             "periodic": flt.trigger_periodic("time", 24, 5), "in_window": flt.trigger_window("time", 48, 96),
             "random": flt.trigger_random("time", 0.25, SEED)}
    fired = flt.trigger_every() & (marks["once"] | marks["once_external"] | marks["periodic"] | marks["in_window"] | marks["random"])
    return star.tracks(spark, d).filter(fired).select("time", "agent_id", *[c.alias(n) for n, c in marks.items()])


@query("flt5_floaters_grouped", with_views("agents") + """SELECT agent_id, 'floater' AS kind FROM agents WHERE alive AND group_id = -1
  UNION ALL SELECT agent_id, 'grouped' FROM agents WHERE alive AND group_id >= 0""")
def flt5(spark, d):
    from pyspark.sql import functions as F
    a = star.agents(spark, d)
    return (flt.floaters(a).select("agent_id", F.lit("floater").alias("kind"))
            .unionByName(flt.grouped(a).select("agent_id", F.lit("grouped").alias("kind"))))


@query("flt6_valid_category", with_views("agents") + "SELECT agent_id, sea_age, sea_age IN (1, 2, 3) AS valid FROM agents")
def flt6(spark, d):
    return star.agents(spark, d).select("agent_id", "sea_age", flt.valid_category_mask("sea_age").alias("valid"))


@query("flt7_compact_remove", with_views("agents", "prey") + """SELECT agent_id, mass_g FROM agents WHERE alive
  AND agent_id NOT IN (SELECT agent_id FROM prey WHERE NOT alive)""")
def flt7(spark, d):
    gone = star.prey(spark, d).filter("not alive")
    return flt.remove(flt.compact(star.agents(spark, d)), gone).select("agent_id", "mass_g")


@query("flt8_water_edges", with_views("edges") + "SELECT src, dst, slot FROM edges")
def flt8(spark, d):
    c = star.cells(spark, d)
    return grid.water_edges(grid.hex_adjacency(c, star.WIDTH), c)


@query("flt9_cells_in_region", with_views("cells") + """SELECT cell_id, CASE WHEN region_id < 0 THEN 'Land'
  WHEN region_id < 5 THEN ['Upper','Middle','Lower','Lagoon','Coast'][region_id + 1] ELSE 'Unknown' END AS label,
  region_id = 3 AS in_lagoon FROM cells""")
def flt9(spark, d):
    from pyspark.sql import functions as F
    c = star.cells(spark, d)
    inside = flt.cells_in_region(c, REGIONS, "Lagoon").select("cell_id", F.lit(True).alias("hit"))
    return c.join(inside, "cell_id", "left").select("cell_id", flt.region_label(REGIONS).alias("label"),
                                                    F.coalesce("hit", F.lit(False)).alias("in_lagoon"))


@query("flt10_subsample", with_views("agents") + f"SELECT agent_id, mass_g FROM agents ORDER BY {sql_u('subsample', 'agent_id', seed=0)}, agent_id LIMIT 200")
def flt10(spark, d):
    return flt.subsample(star.agents(spark, d), "agent_id", 200).select("agent_id", "mass_g")
