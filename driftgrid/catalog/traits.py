"""Queries for traits."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.operators import traits as trt
from driftgrid.plans import star
from driftgrid.plans.star import SEED, sql_u, with_views

PHENOTYPE = [[0, 1, 1], [1, 2, 2], [1, 2, 0]]
CHAIN = [[0.7, 0.2, 0.1, 0.0], [0.0, 0.5, 0.3, 0.2], [0.0, 0.0, 0.6, 0.4]]   # the last category has no row
LABELS = ["egg", "fry", "adult", "spawner"]


@query("trt1_bin_trait", with_views("agents") + """SELECT agent_id, CASE WHEN stage = 3 THEN 3 ELSE (acc1 >= 0)::INT + (acc1 >= 2500)::INT
  + (acc1 >= 7500)::INT END AS size_class FROM agents""")
def trt1(spark, d):
    value = F.when(F.col("stage") == 3, F.lit(float("nan"))).otherwise(F.col("acc1"))
    return star.agents(spark, d).select("agent_id", trt.bin_trait(value, [0, 2500, 7500]).alias("size_class"))


@query("trt2_genetic_trait", with_views("genotypes") + """SELECT agent_id, [[0,1,1],[1,2,2],[1,2,0]][a0 + 1][a1 + 1] AS colour
  FROM genotypes WHERE locus = 'A'""")
def trt2(spark, d):
    g = star.genotypes(spark, d).filter("locus = 'A'")
    return trt.genetic_trait(g, "colour", "a0", "a1", PHENOTYPE).select("agent_id", "colour")


@query("trt3_polygenic_trait", with_views("genotypes") + """SELECT agent_id, score, (score >= 3)::INT + (score >= 6)::INT AS category FROM (
  SELECT agent_id, sum(CASE locus WHEN 'B' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * (a0 + a1)) AS score FROM genotypes WHERE locus IN ('B', 'D') GROUP BY 1)""")
def trt3(spark, d):
    return trt.polygenic_trait(star.genotypes(spark, d), {"B": 1.0, "D": 0.5}, [3, 6])


@query("trt4_category_names", with_views("agents") + "SELECT agent_id, ['egg','fry','adult','spawner'][stage + 1] AS label FROM agents")
def trt4(spark, d):
    return star.agents(spark, d).select("agent_id", trt.category_name("stage", LABELS).alias("label"))


@query("trt5_markov_transition", with_views("agents") + f"""SELECT agent_id, CASE WHEN NOT alive OR stage = 3 THEN stage
  WHEN stage = 0 THEN (u >= 0.7::DOUBLE)::INT + (u >= 0.7::DOUBLE + 0.2::DOUBLE)::INT + (u >= 0.7::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE)::INT
  WHEN stage = 1 THEN 1 + (u >= 0.5::DOUBLE)::INT + (u >= 0.5::DOUBLE + 0.3::DOUBLE)::INT
  ELSE 2 + (u >= 0.6::DOUBLE)::INT END AS stage FROM (SELECT *, {sql_u('transition', 'agent_id')} AS u FROM agents)""")
def trt5(spark, d):
    return trt.markov_transition(star.agents(spark, d), "stage", CHAIN, SEED, mask=F.col("alive")).select("agent_id", "stage")


@query("trt6_transition_counts", with_views("tracks") + """SELECT "time", f AS "from", behavior AS "to", count(*) AS n FROM (
  SELECT *, lag(behavior) OVER (PARTITION BY agent_id ORDER BY "time") AS f FROM tracks) WHERE f IS NOT NULL GROUP BY ALL""")
def trt6(spark, d):
    return trt.transition_counts(star.tracks(spark, d), "behavior")


@query("trt7_set_traits", with_views("agents") + "SELECT agent_id, CASE WHEN alive THEN 2 ELSE stage END AS stage, CASE WHEN alive THEN 0 ELSE origin END AS origin FROM agents")
def trt7(spark, d):
    return trt.set_traits(star.agents(spark, d), {"stage": LABELS, "origin": ["wild", "reared"]},
                          {"stage": "adult", "origin": 0}, F.col("alive")).select("agent_id", "stage", "origin")
