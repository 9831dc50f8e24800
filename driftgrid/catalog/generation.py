"""Queries for row generation, sampling and genetics."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.functions.rand import cumulative, poisson_cdf
from driftgrid.operators import generation as gen
from driftgrid.operators import genetics as gtc
from driftgrid.operators import neighbours as nb
from driftgrid.operators import tracks as trk
from driftgrid.plans import star
from driftgrid.plans.star import LOCI, SEED, sql_u, with_views

A = with_views("agents")


def sql_le(u, bounds):
    return f"len(list_filter([{', '.join(repr(float(b)) + '::DOUBLE' for b in bounds)}], lambda c: c <= {u}))"


def sql_normal(stream, *keys):
    return f"(sqrt(-2.0 * ln(1.0 - {sql_u(stream + '.r', *keys)})) * cos(2.0 * pi() * {sql_u(stream + '.a', *keys)}))"


def sql_mass(mean, sd, stream, *keys):
    return f"round(least(greatest({mean} + {sd} * {sql_normal(stream, *keys)}, {0.5 * mean}), {1.5 * mean}), 6)"


SQL_ABLE = f""", able AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS gs FROM agents WHERE alive AND NOT arrived AND group_id >= 0),
  sp AS (SELECT *, u AS cu, {sql_le('u', poisson_cdf(4.0))} AS clutch FROM (SELECT *, {sql_u('clutch', 'agent_id')} AS u FROM able WHERE gs >= 40
   AND NOT (origin = 1 AND {sql_u('skip', 'agent_id')} < 0.3::DOUBLE)))
"""


@query("gen1_reproduce", A + SQL_ABLE + f"""SELECT agent_id AS parent_id, k::INTEGER AS child_no, cell, {sql_mass(100.0, 20.0, 'child.mass', 'agent_id', 'k')} AS mass_g, 0 AS origin, -1 AS group_id
  FROM sp, range(1, 40) t(k) WHERE k <= clutch""")
def gen1(spark, d):
    kids = gen.reproduce(star.agents(spark, d), 4.0, 40, 0.3, SEED)
    return kids.select("parent_id", "child_no", "cell", F.round("mass_g", 6).alias("mass_g"), "origin", "group_id")


SQL_MATE = f""", mem AS (SELECT group_id, agent_id, row_number() OVER (PARTITION BY group_id ORDER BY agent_id) AS r, count(*) OVER (PARTITION BY group_id) AS k FROM agents WHERE alive AND group_id >= 0),
  par AS (SELECT a.agent_id, a.group_id, m.r, coalesce(s.k, 0) - (m.r IS NOT NULL)::INT AS others, {sql_u('mate', 'a.agent_id')} AS u FROM agents a LEFT JOIN mem m ON m.agent_id = a.agent_id
   LEFT JOIN (SELECT DISTINCT group_id, k FROM mem) s ON s.group_id = a.group_id),
  pk AS (SELECT agent_id, group_id, CASE WHEN others > 0 THEN CASE WHEN r IS NOT NULL AND floor(u * others) + 1 >= r THEN floor(u * others) + 2 ELSE floor(u * others) + 1 END END AS pick FROM par),
  mt AS (SELECT pk.agent_id, coalesce(mem.agent_id, pk.agent_id) AS mate_id FROM pk LEFT JOIN mem ON mem.group_id = pk.group_id AND mem.r = pick)
"""


@query("gen2_pick_mate", A + SQL_MATE + "SELECT agent_id, mate_id FROM mt")
def gen2(spark, d):
    a = star.agents(spark, d).select("agent_id", "group_id", "alive")
    return gen.pick_mate(a, a, SEED).select("agent_id", "mate_id")


def sql_placed(weight, views=("agents", "cells")):
    return with_views(*views) + f""", w AS (SELECT cell_id, sum({weight}) OVER (ORDER BY cell_id) AS hi, {weight} AS wt FROM cells WHERE {weight} > 0),
  dr AS (SELECT agent_id, {sql_u('introduce', 'agent_id')} * (SELECT max(hi) FROM w)::DOUBLE AS u FROM agents),
  pl AS (SELECT agent_id, cell_id AS cell FROM dr JOIN w ON hi - wt <= u AND u < hi)
"""


@query("gen3_introduce", sql_placed("(CASE WHEN resource <> 0 THEN depth ELSE 0 END)") + f"SELECT agent_id, cell, {sql_mass(3500.0, 500.0, 'mass', 'agent_id')} AS mass_g FROM pl")
def gen3(spark, d):
    out = gen.introduce(star.agents(spark, d).select("agent_id"), star.cells(spark, d), "resource", "depth", SEED)
    return out.select("agent_id", "cell", F.round("mass_g", 6).alias("mass_g"))


@query("gen3_introduce_at", A + f"SELECT agent_id, ([5, 17, 123][agent_id % 3 + 1])::BIGINT AS cell, {sql_mass(3500.0, 500.0, 'mass', 'agent_id')} AS mass_g FROM agents")
def gen3p(spark, d):
    out = gen.introduce_at(star.agents(spark, d).select("agent_id"), [5, 17, 123], SEED)
    return out.select("agent_id", "cell", F.round("mass_g", 6).alias("mass_g"))


@query("gen4_introduce_patch", with_views("cells") + "SELECT cell_id AS cell FROM cells WHERE resource <> 0")
def gen4(spark, d):
    return gen.introduce_patch(star.cells(spark, d), "resource")


AGES = {1: 0.4, 2: 0.35, 3: 0.25}


@query("gen5_sample_category", A + f"SELECT agent_id, ([1, 2, 3][{sql_le(sql_u('sea_age', 'agent_id'), cumulative([0.4, 0.35, 0.25])[:-1])} + 1])::INTEGER AS sea_age FROM agents")
def gen5(spark, d):
    return gen.sample_category(star.agents(spark, d).drop("sea_age"), "sea_age", AGES, SEED, "sea_age").select("agent_id", "sea_age")


FRACTIONS = {0: 0.51, 1: 0.27, 3: 0.22}
PRECISION = {0: 0.9, 1: 0.6}


def _sql_homing():
    parts = []
    for natal in FRACTIONS:
        others = [b for b in sorted(FRACTIONS) if b != natal]
        total = sum(FRACTIONS[b] for b in others)
        for org, p in PRECISION.items():
            probs = [p] + [(1 - p) * FRACTIONS[b] / total for b in others]
            cum, acc = [], 0.0
            for x in probs[:-1]:
                acc += x
                cum.append(acc)
            parts.append(f"WHEN natal = {natal} AND origin = {org} THEN [{', '.join(map(str, [natal, *others]))}][{sql_le('u', cum)} + 1]")
    return "CASE " + " ".join(parts) + " ELSE region_id END"


@query("gen7_homing_draw", with_views("tracks", "edges") + f""", r AS (SELECT t.*, region_id FROM tracks t LEFT JOIN cells ON cell = cell_id),
  nat AS (SELECT agent_id, coalesce(region_id, -1) AS natal FROM r QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY "time") = 1),
  ft AS (SELECT agent_id, region_id, cell, origin, natal, {sql_u('homing', 'agent_id')} AS u FROM r JOIN nat USING (agent_id) WHERE alive AND region_id IN (0, 1, 3)
   QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY "time") = 1),
  en AS (SELECT region_id AS rid, cell_id AS entry FROM cells LEFT JOIN (SELECT DISTINCT src FROM edges) ON src = cell_id WHERE region_id >= 0 QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY src IS NULL, cell_id) = 1),
  dr AS (SELECT *, ({_sql_homing()})::INTEGER AS exit_branch FROM ft)
  SELECT agent_id, exit_branch, CASE WHEN exit_branch <> region_id THEN entry ELSE cell END AS new_cell FROM dr LEFT JOIN en ON rid = exit_branch""")
def gen7(spark, d):
    t, c = star.tracks(spark, d), star.cells(spark, d)
    seen = trk.with_region(t, c).filter(F.col("alive") & F.col("region_id").isin([0, 1, 3]))
    touch = (seen.groupBy("agent_id").agg(F.min_by(F.struct("region_id", "cell", "origin"), "time").alias("s")).select("agent_id", "s.*")
             .join(trk.natal_region(t, c), "agent_id"))
    return gen.homing_draw(touch, c, star.edges(spark, d), FRACTIONS, PRECISION, SEED).select("agent_id", "exit_branch", "new_cell")


@query("gen8_entry_cell", with_views("edges") + """, en AS (SELECT region_id, cell_id AS entry FROM cells LEFT JOIN (SELECT DISTINCT src FROM edges) ON src = cell_id WHERE region_id >= 0
   QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY src IS NULL, cell_id) = 1)
  SELECT region_id, coalesce(entry, -1)::BIGINT AS entry FROM (SELECT DISTINCT (l_linenumber - 1)::INTEGER AS region_id FROM lineitem) LEFT JOIN en USING (region_id)""")
def gen8(spark, d):
    wanted = star.table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).cast("int").alias("region_id")).distinct()
    return gen.entry_cell(star.cells(spark, d), star.edges(spark, d), wanted)


@query("gen9_disperse_seeds", with_views("agents", "edges") + f""", nbs AS (SELECT src, list(dst ORDER BY slot) AS l FROM edges GROUP BY 1),
  s0 AS (SELECT agent_id AS p, cell, k::INTEGER AS k FROM (SELECT *, {sql_le('u', poisson_cdf(2.0))} AS n FROM (SELECT *, {sql_u('seeds', 'agent_id')} AS u FROM agents WHERE alive)), range(1, 40) t(k) WHERE k <= n),
  """ + ",\n  ".join(f"""s{h + 1} AS (SELECT p, k, CASE WHEN {sql_u(f'seed.go.{h}', 'p', 'k')} < 0.5::DOUBLE AND l IS NOT NULL
   THEN l[least(floor({sql_u(f'seed.hop.{h}', 'p', 'k')} * len(l)), len(l) - 1)::INT + 1] ELSE cell END AS cell FROM s{h} LEFT JOIN nbs ON src = cell)""" for h in range(3)) + """
  SELECT p AS parent_id, k AS seed_no, cell, 1.0::DOUBLE AS mass_g, 1.0::DOUBLE AS ed_kJ_g FROM s3 JOIN cells ON cell = cell_id WHERE resource >= 2""")
def gen9(spark, d):
    c = star.cells(spark, d)
    producers = star.agents(spark, d).filter("alive").select("agent_id", "cell")
    return gen.disperse_seeds(producers, nb.adjacency(c, star.edges(spark, d)), c, "resource", 2.0, 3, 2.0, SEED).select("parent_id", "seed_no", "cell", "mass_g", "ed_kJ_g")


@query("gen10_init_agents", sql_placed("water::INT") + f"""SELECT agent_id, cell, {sql_mass(3500.0, 500.0, 'mass', 'agent_id')} AS mass_g,
  trunc(greatest(720.0 + 168.0 * {sql_normal('spawn', 'agent_id')}, 1.0))::INTEGER AS target_spawn_hour FROM pl""")
def gen10(spark, d):
    out = gen.init_agents(star.agents(spark, d).select("agent_id"), star.cells(spark, d), SEED)
    return out.select("agent_id", "cell", F.round("mass_g", 6).alias("mass_g"), "target_spawn_hour")


@query("gen11_parameter_overrides", """, base AS (SELECT DISTINCT p_brand AS grp, p_size::VARCHAR AS name, 1.0::DOUBLE AS value FROM part),
  ov AS (SELECT p_brand AS grp, p_size::VARCHAR AS name, max(p_retailprice) AS value FROM part WHERE p_type LIKE 'E%' GROUP BY 1, 2)
  SELECT b.grp, b.name, coalesce(o.value, b.value) AS value FROM base b LEFT JOIN ov o USING (grp, name) WHERE b.grp NOT IN ('Brand#7') OR NOT EXISTS (SELECT 1 FROM ov WHERE grp = 'Brand#7')
  UNION ALL SELECT grp, name, value FROM ov WHERE grp = 'Brand#7'""".replace(", base", "WITH base", 1))
def gen11(spark, d):
    p = star.table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("string").alias("name"), "p_retailprice", "p_type")
    base = p.select("grp", "name").distinct().withColumn("value", F.lit(1.0))
    over = p.filter("p_type like 'E%'").groupBy("grp", "name").agg(F.max("p_retailprice").alias("value"))
    return gen.parameter_overrides(base, over, ("Brand#7",))


# --- genetics ---------------------------------------------------------------------------------

def _sql_gamete(name, parent):
    return f"""{name} AS (SELECT child_id, locus_idx, CASE WHEN sum(f) OVER (PARTITION BY child_id ORDER BY locus_idx) % 2 = 0 THEN a0 ELSE a1 END AS allele FROM (
   SELECT child_id, g.locus_idx, a0, a1, CASE WHEN pp IS NULL THEN ({sql_u('strand.' + parent, 'child_id', 'g.locus_idx')} >= 0.5)::INT
    ELSE ({sql_u('strand.' + parent, 'child_id', 'g.locus_idx')} < 0.5 * (1 - exp(-2 * abs(position_cm - pp) / 100)))::INT END AS f
   FROM kids JOIN (SELECT *, lag(position_cm) OVER (PARTITION BY agent_id ORDER BY locus_idx) AS pp FROM genotypes) g ON g.agent_id = kids.{parent}))"""


SQL_KIDS = with_views("genotypes") + """, kids AS (SELECT o_orderkey AS child_id, o_custkey AS parent1_id, (o_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS parent2_id FROM orders),
  """


def kids(spark, d):
    n = star.table(spark, d, "customer").agg(F.count(F.lit(1))).scalar()
    return star.table(spark, d, "orders").select(F.col("o_orderkey").alias("child_id"), F.col("o_custkey").alias("parent1_id"),
                                                 ((F.col("o_custkey") * 7 + 3) % n).alias("parent2_id"))


@query("gen21_gametes", SQL_KIDS + _sql_gamete("g1", "parent1_id") + " SELECT child_id, locus_idx, allele FROM g1")
def gen21(spark, d):
    return gtc.gametes(kids(spark, d), star.genotypes(spark, d), SEED, "parent1_id")


@query("gen22_recombine", SQL_KIDS + _sql_gamete("g1", "parent1_id") + ",\n  " + _sql_gamete("g2", "parent2_id") +
       " SELECT child_id AS agent_id, locus_idx, g1.allele AS a0, g2.allele AS a1 FROM g1 JOIN g2 USING (child_id, locus_idx)")
def gen22(spark, d):
    return gtc.recombine(kids(spark, d), star.genotypes(spark, d), SEED)


MUTATION = [[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.0, 0.2, 0.8]]


def _sql_mut(c):
    rows = "[" + ", ".join("[" + ", ".join(repr(x) + "::DOUBLE" for x in cumulative(r)[:-1]) + "]" for r in MUTATION) + "]"
    return f"CASE WHEN locus = 'A' THEN len(list_filter({rows}[{c} + 1], lambda x: x <= {sql_u('mutate.' + c, 'agent_id', 'locus_idx')}))::INTEGER ELSE {c} END"


@query("gen23_mutate", with_views("genotypes") + f"""SELECT agent_id, locus_idx, n0 AS a0, n1 AS a1, (n0 <> a0)::INT + (n1 <> a1)::INT AS changed
  FROM (SELECT *, {_sql_mut('a0')} AS n0, {_sql_mut('a1')} AS n1 FROM genotypes)""")
def gen23(spark, d):
    return gtc.mutate(star.genotypes(spark, d), "A", MUTATION, SEED).select("agent_id", "locus_idx", "a0", "a1", "changed")


@query("gen24_random_genotypes", with_views("genotypes") + "SELECT agent_id, locus_idx, a0, a1 FROM genotypes")
def gen24(spark, d):
    ids = star.table(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"))
    return gtc.random_genotypes(ids, LOCI, SEED).select("agent_id", "locus_idx", "a0", "a1")


@query("gen25_locus", with_views("genotypes") + "SELECT agent_id, a0, a1 FROM genotypes WHERE locus = 'C'")
def gen25(spark, d):
    return gtc.locus(star.genotypes(spark, d), "C")


@query("gen6_bernoulli_each_step", with_views("tracks") + f"""SELECT agent_id, "time", {sql_u('each', 'agent_id', '"time"')} < 0.05::DOUBLE AS hit FROM tracks""")
def gen6_each_step(spark, d):
    return gen.bernoulli(star.tracks(spark, d), "hit", 0.05, SEED, "each", ("agent_id", "time")).select("agent_id", "time", "hit")
