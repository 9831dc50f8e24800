"""Queries that write a whole derived table in a file format and read it back, and step composition."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.operators import reports as rep
from driftgrid.operators import steps as st
from driftgrid.plans import star
from driftgrid.plans.lineage import work_path
from driftgrid.plans.star import with_views
from driftgrid.sources import readers as rd
from driftgrid.sources import writers as wr


def file_tracks(spark, d):
    t = star.tracks(spark, d)
    return t.select("time", F.col("agent_id").cast("int").alias("agent_id"), F.col("cell").alias("tri_idx"), (F.lit(55.0) + F.col("cell") / 1000).alias("lat"),
                    (F.lit(21.0) + F.col("cell") / 2000).alias("lon"), "ed_kJ_g", "behavior", "alive", "arrived", F.lit(-1).cast("byte").alias("natal_reach_id"),
                    F.lit(-1).cast("byte").alias("exit_branch_id"), F.col("origin").cast("byte").alias("origin"), F.lit(-1).cast("byte").alias("sea_age"), "mass_g")


SQL_FILE = """SELECT "time", agent_id::INTEGER AS agent_id, cell AS tri_idx, 55.0::DOUBLE + cell / 1000 AS lat, 21.0::DOUBLE + cell / 2000 AS lon, ed_kJ_g, behavior, alive, arrived,
  {natal}::TINYINT AS natal_reach_id, {natal}::TINYINT AS exit_branch_id, {origin}::TINYINT AS origin, {natal}::TINYINT AS sea_age FROM tracks"""


@query("src1_read_tracks", with_views("tracks") + SQL_FILE.format(natal="(-1)", origin="origin"))
def src1(spark, d):
    path = work_path(spark, "tracks")
    wr.write_tracks(file_tracks(spark, d), path, "csv")
    return rd.read_tracks(spark, path)


@query("src1_read_old_tracks", with_views("tracks") + SQL_FILE.format(natal="NULL", origin="NULL"))
def src1o(spark, d):
    path = work_path(spark, "tracks")
    wr.write_tracks(file_tracks(spark, d).drop("natal_reach_id", "exit_branch_id", "origin", "sea_age"), path, "csv")
    return rd.read_tracks(spark, path)


@query("snk1_write_tracks", with_views("tracks") + 'SELECT "time", agent_id::INTEGER AS agent_id, cell AS tri_idx, ed_kJ_g FROM tracks')
def snk1(spark, d):
    path = work_path(spark, "tracks")
    wr.write_tracks(file_tracks(spark, d), path)
    return spark.read.parquet(path).select("time", "agent_id", "tri_idx", "ed_kJ_g")


@query("snk2_write_snapshot", with_views("tracks") + 'SELECT "time", cell AS tri_idx, alive, behavior, ed_kJ_g, mass_g FROM tracks')
def snk2(spark, d):
    path = work_path(spark, "snapshots")
    wr.write_snapshot(file_tracks(spark, d), path)
    return spark.read.parquet(f"{path}/snapshot").select("time", "tri_idx", "alive", "behavior", "ed_kJ_g", "mass_g")


@query("snk3_write_reports", with_views("tracks", "cells") + """SELECT 'alive' AS report, "time"::BIGINT AS key, count(*) FILTER (alive) AS n FROM tracks GROUP BY 2
  UNION ALL SELECT 'density', cell_id, coalesce(n, 0) FROM cells LEFT JOIN (SELECT cell, count(*) AS n FROM tracks WHERE alive GROUP BY 1) ON cell = cell_id""")
def snk3(spark, d):
    path, t = work_path(spark, "reports"), star.tracks(spark, d)
    wr.write_reports({"alive": rep.step_summary(t).select("time", "n_alive"), "empty": t.filter("time < 0").select("time")}, path,
                     {"density": rep.density(t, star.cells(spark, d))})
    a = spark.read.schema("time long, n_alive long").option("header", True).csv(f"{path}/alive.csv")
    return (a.select(F.lit("alive").alias("report"), F.col("time").alias("key"), F.col("n_alive").alias("n"))
            .unionByName(spark.read.parquet(f"{path}/density").select(F.lit("density").alias("report"), F.col("cell_id").alias("key"), "n")))


@query("src2_read_census", with_views("runs") + """SELECT run_id AS pop_id, step, size, round(1.0 + step / 100.0, 6)::DOUBLE AS lambda, k::INTEGER AS trait_index, CASE k WHEN 0 THEN n_arrived ELSE size - n_arrived END AS n
  FROM runs, (VALUES (0), (1)) t(k)""")
def src2(spark, d):
    path, r = work_path(spark, "census"), star.runs(spark, d)
    for pop in range(5):       # one file set per population, as the format asks
        one = r.filter(F.col("run_id") == pop)
        (one.select(F.lit(0).alias("Run"), F.col("step").alias("Time Step"), F.col("size").alias("Population Size"), F.lit(0).alias("Group Members"), F.col("size").alias("Floaters"),
                    F.format_string("%.6f", 1.0 + F.col("step") / 100.0).alias("Lambda"), F.col("n_arrived").alias("Trait Index  0"), (F.col("size") - F.col("n_arrived")).alias("Trait Index  1"))
         .write.option("header", True).csv(f"{path}/scenario.{pop}.csv"))
    return rd.read_census(spark, f"{path}/*")


@query("src3_read_probe", with_views("agents") + """SELECT origin AS pop_id, steps AS step, agent_id, CASE WHEN origin = 0 THEN 'mass' ELSE 'Acc0' END AS acc, mass_g AS value FROM agents
  UNION ALL SELECT origin, steps, agent_id, CASE WHEN origin = 0 THEN 'energy' ELSE 'Acc1' END, CASE WHEN alive THEN ed_kJ_g ELSE 0.0 END FROM agents""")
def src3(spark, d):
    path = work_path(spark, "probe")
    a = star.agents(spark, d)
    (a.select(F.lit(0).alias("Run"), F.col("steps").alias("Time Step"), F.col("origin").alias("Population"), F.col("agent_id").alias("Individual"), F.col("mass_g").alias("Acc0"),
              F.when(F.col("alive"), F.col("ed_kJ_g").cast("string")).otherwise("dead").alias("Acc1")).write.option("header", True).csv(path))
    names = spark.createDataFrame([(0, 0, "mass"), (0, 1, "energy")], "pop_id int, idx int, acc string")
    return rd.read_probe(spark, path, names)


@query("src4_read_census_log", with_views("runs") + "SELECT step, run_id AS pop_id, size FROM runs")
def src4(spark, d):
    path = work_path(spark, "log")
    r = star.runs(spark, d)
    lines = r.select(F.explode(F.array(F.format_string("CEN, %d, %d, %d, x", "step", "run_id", "size"), F.format_string("LOG %d", "step"), F.lit("CEN,1"))).alias("value"))
    lines.write.text(path)
    return rd.read_census_log(spark, path)


@query("src5_read_barrier_text", """SELECT l_partkey AS hex_id, (l_linenumber % 6)::INTEGER AS edge, (l_linenumber % 4)::INTEGER AS class_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Low dam' WHEN 2 THEN 'Dam' ELSE '' END AS class_name, CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 WHEN 2 THEN 1.0 END::DOUBLE AS p1,
  CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 END::DOUBLE AS p2 FROM lineitem""")
def src5(spark, d):
    path = work_path(spark, "barriers")
    classes = spark.createDataFrame([('C 0 0.0 0.0 "Open"',), ('C 1 0.25 0.5 "Low dam"',), ('C 2 1.0 1.0 "Dam"',)], "value string")
    rows = star.table(spark, d, "lineitem").select(F.format_string("E %d %d %d", "l_partkey", F.col("l_linenumber") % 6, F.col("l_linenumber") % 4).alias("value"))
    rows.unionByName(classes).write.text(path)
    return rd.read_barrier_text(spark, path)


@query("src6_read_edge_outcomes", with_views("edges") + """SELECT src::VARCHAR AS from_id, dst::VARCHAR AS to_id, 0.1::DOUBLE AS p_mort, CASE slot WHEN 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS p_defl,
  CASE slot WHEN 0 THEN 0.4 ELSE 0.65 END::DOUBLE AS p_trans FROM edges""")
def src6(spark, d):
    path, e = work_path(spark, "edges"), star.edges(spark, d)
    p = e.select(F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_id"), F.lit(0.1).alias("p_mort"), F.when(F.col("slot") == 0, 0.5).otherwise(0.25).alias("p_defl"),
                 F.when(F.col("slot") == 0, 0.4).otherwise(0.65).alias("p_trans"))
    off_mesh = p.limit(1).withColumns({"to_id": F.lit("-7")})      # an edge that leaves the mesh is dropped
    wr.write_edge_outcomes(p.unionByName(off_mesh), path, "generated")
    return rd.read_edge_outcomes(spark, path, star.cells(spark, d), e)


@query("snk4_write_edge_outcomes", with_views("edges") + """SELECT src::VARCHAR AS from_h3, dst::VARCHAR AS to_h3, '0.3333' AS mortality, '0.3333' AS deflection, '0.3334' AS transmission, 'dam' AS note FROM edges""")
def snk4(spark, d):
    path = work_path(spark, "edges")
    p = star.edges(spark, d).select(F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_id"), F.lit(1 / 3).alias("p_mort"), F.lit(1 / 3).alias("p_defl"), F.lit(0.33338).alias("p_trans"))
    wr.write_edge_outcomes(p, path, "dam")
    return spark.read.option("header", True).csv(path)


@query("src7_read_matrix_csv", """SELECT (l_linenumber - 1)::BIGINT AS "row", (k - 1)::BIGINT AS col, round(avg(CASE WHEN datediff('day', DATE '1995-01-01', l_shipdate::DATE) % 3 = k - 1 THEN l_quantity ELSE 0 END), 6) AS value
  FROM lineitem, (VALUES (1), (2), (3)) t(k) GROUP BY 1, 2, l_linenumber, k""")
def src7(spark, d):
    """A zone x step table of seven rows, aggregated from every line item, in one headed file."""
    path = work_path(spark, "matrix")
    day = star.day_of("l_shipdate") % 3
    z = star.table(spark, d, "lineitem").groupBy("l_linenumber").agg(*[F.round(F.avg(F.when(day == k, F.col("l_quantity")).otherwise(0.0)), 6).alias(f"t{k}") for k in range(3)])
    z.coalesce(1).sortWithinPartitions("l_linenumber").select("t0", "t1", "t2").write.option("header", True).csv(path)
    return rd.read_matrix_csv(spark, path)


@query("src8_layer_csv", with_views("cells") + "SELECT cell_id, round(resource * area / 7, 6) AS value FROM cells WHERE resource <> 0")
def src8(spark, d):
    path = work_path(spark, "layer")
    wr.write_layer_csv(star.cells(spark, d).select("cell_id", (F.col("resource") * F.col("area") / 7).alias("value")), path)
    return rd.read_layer_csv(spark, path)


@query("src9_read_gridded", with_views("field") + """SELECT t AS "time", 54 + (cell_id // 40) / 100 AS lat, 20 + (cell_id % 40) / 100 AS lon, var, value FROM (SELECT cell_id, t, 'tos' AS var, temperature AS value FROM field
  UNION ALL SELECT cell_id, t, 'sos', salinity FROM field) WHERE t >= 6 AND t < 18""")
def src9(spark, d):
    path = work_path(spark, "forcing")
    f = star.field(spark, d)
    long = f.select(F.col("t").alias("time"), (F.lit(54) + F.expr("cell_id div 40") / 100).alias("lat"), (F.lit(20) + (F.col("cell_id") % 40) / 100).alias("lon"),
                    F.explode(F.array(F.struct(F.lit("thetao").alias("var"), F.col("temperature").alias("value")), F.struct(F.lit("so").alias("var"), F.col("salinity").alias("value")),
                                      F.struct(F.lit("uo").alias("var"), F.col("u").alias("value")))).alias("s")).select("time", "lat", "lon", "s.*")
    long.write.parquet(path)
    return rd.read_gridded(spark, path, 6, 18, ["thetao", "so"])


@st.register("keep_alive")
def keep_alive(df):
    return df.filter("alive")


@st.register("add_mass")
def add_mass(df, grams=1.0):
    return df.withColumn("mass_g", F.col("mass_g") + grams)


@query("udf1_registered_steps", with_views("agents") + "SELECT agent_id, mass_g + 5 AS mass_g FROM agents WHERE alive")
def udf1(spark, d):
    return st.chain(star.agents(spark, d).select("agent_id", "mass_g", "alive"), ["keep_alive", ("add_mass", {"grams": 5.0})]).select("agent_id", "mass_g")


def halve(batches):
    for pdf in batches:
        pdf["mass_g"] = pdf["mass_g"] / 2
        yield pdf


@query("udf2_custom_callback", with_views("agents") + "SELECT agent_id, mass_g / 2 AS mass_g FROM agents")
def udf2(spark, d):
    return st.custom(star.agents(spark, d).select("agent_id", "mass_g"), halve, "agent_id long, mass_g double")


def grow(df):
    return df.withColumn("mass_g", F.when(F.col("in_mask"), F.col("mass_g") + 400).otherwise(F.col("mass_g")))


@query("udf4_grouped_repeat", with_views("agents") + """SELECT agent_id, CASE WHEN m0 < 3200 THEN CASE WHEN m0 + 800 < 3200 THEN m0 + 1600 ELSE m0 + 800 END ELSE m0 END AS mass_g FROM (SELECT agent_id, mass_g AS m0 FROM agents)""")
def udf4(spark, d):
    a = star.agents(spark, d).select("agent_id", "mass_g")
    return st.repeat(a, [grow, grow], 2, lambda: F.col("mass_g") < 3200)
