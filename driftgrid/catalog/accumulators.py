"""Queries for the accumulator updaters. Every one runs over all individuals."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.operators import accumulators as acc
from driftgrid.plans import star
from driftgrid.plans.star import SEED, sql_u, with_views

A = with_views("agents")
MASK = "alive AND NOT arrived"


def active():
    return F.col("alive") & ~F.col("arrived")


def projection(name, sql_value, column, mask=True):
    """Register an updater that is one masked projection of acc1."""
    sql = A + (f"SELECT agent_id, (CASE WHEN {MASK} THEN {sql_value} ELSE acc1 END)::DOUBLE AS acc1 FROM agents" if mask
               else f"SELECT agent_id, ({sql_value})::DOUBLE AS acc1 FROM agents")

    @query(name, sql)
    def run(spark, d):
        return acc.update(star.agents(spark, d), "acc1", column(), active() if mask else None).select("agent_id", "acc1")
    return run


projection("acc0_set_clamped", "least(greatest(acc1, 0), 5000)", lambda: acc.set_clamped("acc1", 0.0, 5000.0))
projection("acc1_clear", "25.0", lambda: acc.clear(25.0))
projection("acc2_increment", "least(acc1 + 12.5, 9000)", lambda: acc.increment("acc1", 12.5, hi=9000.0))
projection("acc3_stochastic_increment", f"least(greatest(acc1 + (-50.0::DOUBLE + 100.0::DOUBLE * {sql_u('increment', 'agent_id')}), 0), 9000)",
           lambda: acc.stochastic_increment("acc1", -50.0, 50.0, SEED, lo=0.0, hi=9000.0))
projection("acc4_expression", "CASE WHEN stage = 0 THEN 8000.0 WHEN acc1 < 0 THEN 0.0 ELSE least(sqrt(acc1) * 100 / stage, 8000) END",
           lambda: acc.expression(F.when(F.col("stage") == 0, F.lit(float("inf"))).when(F.col("acc1") < 0, F.lit(float("nan")))
                                  .otherwise(F.expr("sqrt(acc1) * 100 / nullif(stage, 0)")), lo=0.0, hi=8000.0))
projection("acc5_time_step", "steps % 24", lambda: acc.time_step("steps", 24))
projection("acc6_individual_id", "agent_id", lambda: acc.individual_id())
projection("acc7_stochastic_trigger", f"CASE WHEN {sql_u('acc.trigger', 'agent_id')} < 0.3::DOUBLE THEN 1.0 ELSE 0.0 END",
           lambda: acc.stochastic_trigger(0.3, SEED))
projection("acc19_individual_location", "cell", lambda: acc.individual_location())
projection("acc24_trait_index", "stage", lambda: acc.trait_index("stage"))


@query("acc8_quantify_location", with_views("agents", "cells") + f"""SELECT agent_id,
  CASE WHEN {MASK} THEN coalesce(resource, 0) ELSE acc1 END AS acc1 FROM agents a LEFT JOIN cells c ON a.cell = c.cell_id""")
def acc8(spark, d):
    return acc.quantify_location(star.agents(spark, d), "acc1", star.cells(spark, d), "resource", active()).select("agent_id", "acc1")


@query("acc9_transfer", A + f"""SELECT agent_id, CASE WHEN {MASK} THEN s ELSE acc1 END AS acc1,
  CASE WHEN {MASK} THEN least(mass_g + (acc1 - s), 4000) ELSE mass_g END AS mass_g
  FROM (SELECT *, greatest(acc1 - acc1 * 0.4::DOUBLE, 1000.0::DOUBLE) AS s FROM agents)""")
def acc9(spark, d):
    return acc.transfer(star.agents(spark, d), "acc1", "mass_g", 0.4, active(), (1000.0, None), (None, 4000.0)).select("agent_id", "acc1", "mass_g")


@query("acc10_allocated_count", with_views("agents", "ranges") + f"""SELECT agent_id, CASE WHEN {MASK} THEN coalesce(n, 0)::DOUBLE ELSE acc1 END AS acc1
  FROM agents LEFT JOIN (SELECT owner, count(*) AS n FROM ranges GROUP BY 1) r ON agent_id = owner""")
def acc10(spark, d):
    return acc.allocated_count(star.agents(spark, d), "acc1", star.ranges(spark, d), active()).select("agent_id", "acc1")


@query("acc11_explored_count", with_views("agents", "tracks") + f"""SELECT agent_id, CASE WHEN {MASK} THEN coalesce(n, 0)::DOUBLE ELSE acc1 END AS acc1
  FROM agents LEFT JOIN (SELECT agent_id, count(DISTINCT cell) AS n FROM tracks WHERE cell >= 0 GROUP BY 1) USING (agent_id)""")
def acc11(spark, d):
    history = star.tracks(spark, d).filter("cell >= 0")
    return acc.explored_count(star.agents(spark, d), "acc1", history, mask=active()).select("agent_id", "acc1")


@query("acc12_group_size", A + f"""SELECT agent_id, CASE WHEN NOT ({MASK}) THEN acc1 WHEN group_id < 0 THEN 0
  ELSE (count(*) FILTER ({MASK}) OVER (PARTITION BY group_id))::DOUBLE END AS acc1 FROM agents""")
def acc12(spark, d):
    return acc.group_size(star.agents(spark, d), "acc1", active()).select("agent_id", "acc1")


@query("acc13_group_sum", A + f"""SELECT agent_id, CASE WHEN NOT ({MASK}) OR group_id < 0 THEN acc1
  ELSE (sum(steps) FILTER ({MASK}) OVER (PARTITION BY group_id))::DOUBLE END AS acc1 FROM agents""")
def acc13(spark, d):
    return acc.group_sum(star.agents(spark, d), "acc1", "steps", active()).select("agent_id", "acc1")


@query("acc14_births", with_views("agents") + f"""SELECT agent_id, CASE WHEN {MASK} THEN coalesce(n, 0)::DOUBLE ELSE acc1 END AS acc1
  FROM agents LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = agent_id""")
def acc14(spark, d):
    kids = star.table(spark, d, "orders").select(F.col("o_custkey").alias("parent_id"))
    return acc.births(star.agents(spark, d), "acc1", kids, active()).select("agent_id", "acc1")


@query("acc15_mate_verification", A + """SELECT a.agent_id, CASE WHEN NOT b.alive THEN -1.0 ELSE a.mate END AS mate
  FROM (SELECT *, (agent_id * 7 - 3)::DOUBLE AS mate FROM agents) a LEFT JOIN agents b ON a.mate >= 0 AND a.mate = b.agent_id""")
def acc15(spark, d):
    a = star.agents(spark, d).withColumn("mate", (F.col("agent_id") * 7 - 3).cast("double"))
    return acc.mate_verification(a, "mate").select("agent_id", "mate")


@query("acc16_quantify_extremes", with_views("agents", "cells", "tracks") + """SELECT a.agent_id, coalesce(c.depth, 0) AS here, coalesce(m.mx, 0) AS seen_max,
  coalesce(m.mn, 0) AS seen_min FROM agents a LEFT JOIN cells c ON a.cell = c.cell_id LEFT JOIN (SELECT agent_id, max(depth) AS mx, min(depth) AS mn
  FROM tracks t LEFT JOIN cells c ON t.cell = c.cell_id GROUP BY 1) m ON m.agent_id = a.agent_id""")
def acc16(spark, d):
    a = star.agents(spark, d).select("agent_id", "cell").withColumns({n: F.lit(0.0) for n in ("here", "seen_max", "seen_min")})
    cells, seen = star.cells(spark, d), star.tracks(spark, d)
    a = acc.quantify_extremes(a, "here", cells, "depth")
    a = acc.quantify_extremes(a, "seen_max", cells, "depth", "max", seen)
    return acc.quantify_extremes(a, "seen_min", cells, "depth", "min", seen).select("agent_id", "here", "seen_max", "seen_min")


@query("acc17_presence", with_views("agents", "cells") + """SELECT agent_id, CASE WHEN resource > 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc1
  FROM agents a LEFT JOIN cells c ON a.cell = c.cell_id""")
def acc17(spark, d):
    return acc.presence(star.agents(spark, d), "acc1", star.cells(spark, d), "resource", 3.0).select("agent_id", "acc1")


@query("acc18_uptake_agents", with_views("agents", "cells") + f"""SELECT agent_id, CASE WHEN {MASK} THEN least(acc1 + coalesce(resource, 0) * 0.5::DOUBLE, 9000) ELSE acc1 END AS acc1
  FROM agents a LEFT JOIN cells c ON a.cell = c.cell_id""")
def acc18a(spark, d):
    return acc.uptake(star.agents(spark, d), "acc1", star.cells(spark, d), "resource", 0.5, hi=9000.0, mask=active())[0].select("agent_id", "acc1")


@query("acc18_uptake_layer", with_views("agents", "cells") + f"""SELECT c.cell_id, resource - resource * 0.5::DOUBLE * coalesce(n, 0) AS resource
  FROM cells c LEFT JOIN (SELECT cell, count(*) AS n FROM agents WHERE {MASK} GROUP BY 1) h ON h.cell = c.cell_id""")
def acc18b(spark, d):
    return acc.uptake(star.agents(spark, d), "acc1", star.cells(spark, d), "resource", 0.5, hi=9000.0, mask=active())[1].select("cell_id", "resource")


@query("acc20_resources_allocated", with_views("agents", "ranges", "cells") + """SELECT agent_id, coalesce(s, 0) AS acc1 FROM agents
  LEFT JOIN (SELECT owner, sum(resource) AS s FROM ranges JOIN cells USING (cell_id) GROUP BY 1) ON owner = agent_id""")
def acc20(spark, d):
    return acc.resources_allocated(star.agents(spark, d), "acc1", star.ranges(spark, d), star.cells(spark, d), "resource").select("agent_id", "acc1")


@query("acc21_resources_explored", with_views("agents", "tracks", "cells") + """SELECT agent_id, coalesce(s, 0) AS acc1 FROM agents
  LEFT JOIN (SELECT agent_id, sum(resource) AS s FROM (SELECT DISTINCT agent_id, cell FROM tracks) JOIN cells ON cell = cell_id GROUP BY 1) USING (agent_id)""")
def acc21(spark, d):
    return acc.resources_explored(star.agents(spark, d), "acc1", star.tracks(spark, d), star.cells(spark, d), "resource").select("agent_id", "acc1")


@query("acc22_assign_random_n", A + f"""SELECT agent_id, CASE WHEN {MASK} AND row_number() OVER (PARTITION BY {MASK}
  ORDER BY {sql_u('assign', 'agent_id')}, agent_id) <= 100 THEN 7.0 ELSE acc1 END AS acc1 FROM agents""")
def acc22(spark, d):
    return acc.assign_random_n(star.agents(spark, d), "acc1", 100, 7.0, SEED, active()).select("agent_id", "acc1")


@query("acc23_select_first_n", A + f"""SELECT agent_id, CASE WHEN {MASK} AND group_id >= 0 AND row_number() OVER (PARTITION BY group_id, ({MASK})
  ORDER BY agent_id) <= 3 THEN 1.0 ELSE acc1 END AS acc1 FROM agents""")
def acc23(spark, d):
    return acc.select_first_n_per_group(star.agents(spark, d), "acc1", 3, 1.0, active()).select("agent_id", "acc1")


@query("acc25_data_lookup", A + """, lut AS (SELECT p_size AS k, max(p_retailprice) AS v FROM part GROUP BY 1)
  SELECT agent_id, coalesce(v, 0) AS acc1 FROM agents LEFT JOIN lut ON k = trunc(acc1 / 100)""")
def acc25(spark, d):
    lut = star.table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("row")).agg(F.max("p_retailprice").alias("value"))
    a = star.agents(spark, d).withColumn("key", F.col("acc1") / 100)
    return acc.data_lookup(a, "acc1", lut, "key").select("agent_id", "acc1")


@query("acc26_data_lookup_2d", A + """, lut AS (SELECT l_linenumber AS r, l_quantity::BIGINT AS c, max(l_discount) AS v FROM lineitem GROUP BY 1, 2)
  SELECT agent_id, coalesce(v, 0) AS acc1 FROM agents LEFT JOIN lut ON r = stage + 1 AND c = trunc(acc1 / 100)""")
def acc26(spark, d):
    lut = (star.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("row"), F.col("l_quantity").cast("long").alias("col"))
           .agg(F.max("l_discount").alias("value")))
    a = star.agents(spark, d).withColumns({"rk": F.col("stage") + 1, "ck": F.col("acc1") / 100})
    return acc.data_lookup(a, "acc1", lut, "rk", "ck").select("agent_id", "acc1")


SPECS = [
    {"function": "Increment", "accumulator": "acc1", "parameters": [10]},
    {"function": "Expression", "accumulator": "acc1", "parameters": ["acc1 * 2 - steps"], "bounds": (0, 15000)},
    {"function": "QuantifyLocation", "accumulator": "acc2", "spatial_data": "resource"},
    {"function": "IndividualLocations", "accumulator": "acc3", "stratified_traits": ["stage", "origin"],
     "trait_sizes": [4, 2], "trait_combinations": [1, 0, 0, 1, 1, 0, 0, 1]},
    {"function": "TimeStep", "accumulator": "acc4", "parameters": [24]},
    {"function": "TraitId", "accumulator": "acc5", "source_trait": "stage"},
    {"function": "Expression", "accumulator": "acc2", "parameters": ["acc2 + acc4 + acc5"]},
    {"function": "Clear", "accumulator": "acc6"},
    {"function": "Unheard", "accumulator": "acc6"},
    {"function": "Increment", "accumulator": "missing"},
]


@query("acc27_apply_updaters", with_views("agents", "cells") + f"""SELECT agent_id, CASE WHEN m THEN least(greatest((acc1 + 10) * 2 - steps, 0), 15000) ELSE acc1 END AS acc1,
  CASE WHEN m THEN coalesce(resource, 0) + 4 + stage ELSE 0 END::DOUBLE AS acc2,
  CASE WHEN m AND [1,0,0,1,1,0,0,1][stage * 2 + origin + 1] = 1 THEN cell ELSE 0 END::DOUBLE AS acc3,
  CASE WHEN m THEN 4 ELSE 0 END::DOUBLE AS acc4, CASE WHEN m THEN stage ELSE 0 END::DOUBLE AS acc5, CASE WHEN m THEN 0 ELSE 9 END::DOUBLE AS acc6
  FROM (SELECT *, {MASK} AS m FROM agents) a LEFT JOIN cells c ON a.cell = c.cell_id""")
def acc27(spark, d):
    a = star.agents(spark, d).withColumns({f"acc{i}": F.lit(0.0) for i in (2, 3, 4, 5)} | {"acc6": F.lit(9.0)})
    out = acc.apply_updaters(a, SPECS, t=100, mask=active(), layers=star.cells(spark, d).select("cell_id", "resource"))
    return out.select("agent_id", *[f"acc{i}" for i in range(1, 7)])
