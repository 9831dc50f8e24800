"""Views of the star-schema tables as movement tables, each with its SQL twin.

Every view is a projection or one partial-aggregating groupBy over a whole input table, so the
derived tables grow with the inputs and no key is gathered. The SQL text of each view is used only
by the oracles.

Rules (fixed values):
  tracks       events, one state per (user, hour): the event with the largest id
  cells        part, on a 40-column odd-row hex grid
  edges        adjacency of water cells
  field        lineitem per (part, ship day mod 24)
  agents       customer, one row per individual
  predators, prey   supplier and customer on the nation key
  segments     customer as a stream network that branches upstream
  ranges       lineitem per part: the smallest supplier key owns the cell if its largest quantity is 50
  genotypes    customer x four loci
  runs         orders: five replicates, one size per step
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions.rand import hash_u
from driftgrid.operators.grid import hex_adjacency, hex_centres, water_edges

WIDTH = 40              # columns of the hex grid
FIELD_STEPS = 24        # time steps of the forcing
SEED = 42
EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["Upper", "Middle", "Lower", "Lagoon", "Coast"]
LOCI = [("A", 3, 0.0), ("B", 4, 10.0), ("C", 2, 35.0), ("D", 5, 80.0)]   # name, alleles, cM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Time columns arrive without a zone; keep instants independent of the session zone.
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp_ntz"))
    return df


def hour_of(ts) -> "F.Column":
    """Whole hours since 2024-01-01 00:00."""
    return F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def day_of(ts) -> "F.Column":
    return F.datediff(F.to_date(ts), F.lit("1995-01-01").cast("date"))


def index_of(col: str, names) -> "F.Column":
    return (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(col)) - 1).cast("int")


def tracks(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # Every aggregate keeps numbers only, so the hash aggregate combines them before the shuffle.
    last = e.groupBy(F.col("user_id").alias("agent_id"), hour_of("ts").cast("int").alias("time")).agg(
        F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"),
        F.max_by(index_of("event_type", EVENT_TYPES), "event_id").alias("behavior"))
    hour, agent, ev = F.col("time"), F.col("agent_id"), F.col("event_id")
    return last.select(
        "time", "agent_id",
        F.when(ev % 97 == 0, F.lit(-1)).otherwise(agent * 10 + ev % 25).cast("long").alias("cell"),
        (F.lit(4.0) + F.col("value") / 100.0).alias("ed_kJ_g"),
        (F.lit(3000.0) + F.col("value")).alias("mass_g"), "behavior",
        (~((hour >= 480) & (agent % 7 == 0))).alias("alive"),
        ((hour >= 600) & (agent % 3 == 0)).alias("arrived"),
        (agent % 2).cast("int").alias("origin"),
        (agent % 10 - 1).cast("int").alias("group_id"))


def as_positions(e: DataFrame) -> DataFrame:
    """Events as a position stream, one row per event; works on batch and streaming frames."""
    agent, ev, hour = F.col("user_id"), F.col("event_id"), hour_of("ts").cast("int")
    return e.select(
        agent.alias("agent_id"), ev.alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), hour.alias("hour"),
        F.when(ev % 97 == 0, F.lit(-1)).otherwise(agent * 10 + ev % 25).cast("long").alias("cell"),
        (F.lit(4.0) + F.col("value") / 100.0).alias("ed_kJ_g"), (F.lit(3000.0) + F.col("value")).alias("mass_g"),
        index_of("event_type", EVENT_TYPES).alias("behavior"), (~((hour >= 480) & (agent % 7 == 0))).alias("alive"),
        ((hour >= 600) & (agent % 3 == 0)).alias("arrived"))


def cells(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    base = p.select(
        F.col("p_partkey").alias("cell_id"),
        F.expr(f"p_partkey div {WIDTH}").alias("row"), (F.col("p_partkey") % WIDTH).alias("col"),
        (F.col("p_size") > 4).alias("water"), F.col("p_size").cast("double").alias("depth"),
        F.col("p_retailprice").alias("area"),
        F.when(F.col("p_brand") == "Brand#13", F.lit(-1))
         .otherwise(F.expr(f"((p_partkey div {WIDTH}) div 2) % 5")).cast("int").alias("region_id"),
        (F.col("p_size") % 7).cast("double").alias("resource"),
        (F.col("p_size") / 10.0).alias("dist"),
        (F.col("p_size") % 3).cast("int").alias("level"))
    return hex_centres(base, edge=1.0)


def edges(spark, sf_dir) -> DataFrame:
    c = cells(spark, sf_dir)
    return water_edges(hex_adjacency(c.select("cell_id", "row", "col"), WIDTH), c)


def field(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_partkey").alias("cell_id"),
                   (day_of("l_shipdate") % FIELD_STEPS).cast("int").alias("t")).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_linenumber").alias("n"), F.max("l_quantity").alias("m"))
    return g.select(
        "cell_id", "t",
        F.when(F.col("m") == 50, F.lit(float("nan"))).otherwise(F.lit(5.0) + F.col("q") / 2).alias("temperature"),
        (F.col("n") * 4).alias("salinity"), (F.col("m") / 5).alias("oxygen"),
        ((F.col("q") - 25) / 50).alias("u"), ((F.col("n") - 4) / 8).alias("v"))


def agents(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("agent_id"),
        F.when(k % 29 == 0, F.lit(-1)).otherwise(k - k % 4).cast("long").alias("cell"),
        (F.lit(3000.0) + F.col("c_acctbal") / 10).alias("mass_g"),
        (F.lit(3.5) + (F.col("c_acctbal") + 1000) / 2000).alias("ed_kJ_g"),
        index_of("c_mktsegment", SEGMENTS).alias("behavior"),
        (F.col("c_acctbal") > -500).alias("alive"), (k % 10 == 3).alias("arrived"),
        (k % 2).cast("int").alias("origin"), (k % 6 - 1).cast("int").alias("natal"),
        F.col("c_nationkey").cast("int").alias("nation"),
        (F.col("c_nationkey") - 1).cast("int").alias("group_id"),
        F.col("c_acctbal").alias("acc1"), (k % 720).cast("int").alias("steps"),
        (k % 4).cast("int").alias("stage"),
        F.element_at(F.array(F.lit(-1), F.lit(1), F.lit(2), F.lit(3)), (k % 4 + 1).cast("int")).alias("sea_age"))


def predators(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("agent_id"), F.col("s_nationkey").cast("long").alias("cell"),
                    (F.col("s_acctbal") > 0).alias("alive"), F.col("s_acctbal").alias("acc1"))


def prey(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("agent_id"), F.col("c_nationkey").cast("long").alias("cell"),
                    (F.col("c_acctbal") > 0).alias("alive"))


def segments(spark, sf_dir) -> DataFrame:
    """segment_id, length; upstream neighbours have larger ids, the outlet is 0."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("segment_id"),
                    (F.lit(50.0) + F.abs("c_acctbal") / 100).alias("length"))


def network(spark, sf_dir) -> DataFrame:
    """Directed edges src -> dst, downstream; every fifth segment also joins a second one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src")).filter("src > 0")
    return c.select("src", F.explode(F.when((F.col("src") % 5 == 0) & (F.col("src") > 5), F.array(
        F.expr("(src - 1) div 3"), F.expr("(src - 1) div 2"))).otherwise(F.array(F.expr("(src - 1) div 3")))).alias("dst"))


def ranges(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_partkey").alias("cell_id")).agg(F.min("l_suppkey").alias("owner"), F.max("l_quantity").alias("most"))
    return g.filter("most >= 50").select("cell_id", "owner")


def genotypes(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    loci = F.array(*[F.struct(F.lit(i).alias("locus_idx"), F.lit(n).alias("locus"), F.lit(k).alias("n_alleles"),
                              F.lit(cm).alias("position_cm")) for i, (n, k, cm) in enumerate(LOCI)])
    return (c.select(F.col("c_custkey").alias("agent_id"), F.explode(loci).alias("l")).select("agent_id", "l.*")
            .withColumn("a0", F.floor(hash_u(SEED, "allele0", "agent_id", "locus_idx") * F.col("n_alleles")).cast("int"))
            .withColumn("a1", F.floor(hash_u(SEED, "allele1", "agent_id", "locus_idx") * F.col("n_alleles")).cast("int")))


def runs(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 5).cast("int").alias("run_id"),
                     F.expr("cast(datediff(o_orderdate, date'1995-01-01') div 30 as int)").alias("step")).agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_arrived"))


# --- SQL twins -------------------------------------------------------------------------------

def sql_u(stream: str, *keys: str, seed: int = SEED) -> str:
    """DuckDB text of hash_u."""
    ks = ", ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{stream}', {ks})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def sql_case(col: str, names) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{n}' THEN {i}" for i, n in enumerate(names)) + " END"


SQL = {}
SQL["tracks"] = f"""tracks AS (SELECT "time", agent_id,
  (CASE WHEN event_id % 97 = 0 THEN -1 ELSE agent_id * 10 + event_id % 25 END)::BIGINT AS cell,
  4.0::DOUBLE + value / 100.0::DOUBLE AS ed_kJ_g, 3000.0::DOUBLE + value AS mass_g,
  ({sql_case('event_type', EVENT_TYPES)})::INTEGER AS behavior,
  NOT ("time" >= 480 AND agent_id % 7 = 0) AS alive, ("time" >= 600 AND agent_id % 3 = 0) AS arrived,
  (agent_id % 2)::INTEGER AS origin, (agent_id % 10 - 1)::INTEGER AS group_id
 FROM (SELECT user_id AS agent_id, event_id, event_type, value,
   (datediff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 3600)::INTEGER AS "time",
   row_number() OVER (PARTITION BY user_id, datediff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 3600
     ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)"""
SQL["positions"] = f"""positions AS (SELECT agent_id, event_id, ts, hour, (CASE WHEN event_id % 97 = 0 THEN -1 ELSE agent_id * 10 + event_id % 25 END)::BIGINT AS cell,
  4.0::DOUBLE + value / 100.0::DOUBLE AS ed_kJ_g, 3000.0::DOUBLE + value AS mass_g, ({sql_case('event_type', EVENT_TYPES)})::INTEGER AS behavior,
  NOT (hour >= 480 AND agent_id % 7 = 0) AS alive, (hour >= 600 AND agent_id % 3 = 0) AS arrived
  FROM (SELECT *, user_id AS agent_id, (datediff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 3600)::INTEGER AS hour FROM events))"""
SQL["cells"] = f"""cells AS (SELECT p_partkey AS cell_id, p_partkey // {WIDTH} AS r, p_partkey % {WIDTH} AS c,
  p_size > 4 AS water, p_size::DOUBLE AS depth, p_retailprice AS area,
  (CASE WHEN p_brand = 'Brand#13' THEN -1 ELSE ((p_partkey // {WIDTH}) // 2) % 5 END)::INTEGER AS region_id,
  (p_size % 7)::DOUBLE AS resource, p_size / 10.0::DOUBLE AS dist, (p_size % 3)::INTEGER AS level,
  sqrt(3.0::DOUBLE) * ((p_partkey % {WIDTH}) + 0.5::DOUBLE * ((p_partkey // {WIDTH}) % 2)) AS x,
  1.5::DOUBLE * (p_partkey // {WIDTH}) AS y FROM part)"""
SQL["adj"] = f"""offs(par, slot, dr, dc) AS (VALUES (0,0,-1,-1),(0,1,-1,0),(0,2,0,-1),(0,3,0,1),(0,4,1,-1),(0,5,1,0),
  (1,0,-1,0),(1,1,-1,1),(1,2,0,-1),(1,3,0,1),(1,4,1,0),(1,5,1,1)),
adj AS (SELECT a.cell_id AS src, b.cell_id AS dst, o.slot::INTEGER AS slot FROM cells a JOIN offs o ON a.r % 2 = o.par
  JOIN cells b ON b.r = a.r + o.dr AND b.c = a.c + o.dc)"""
SQL["edges"] = """edges AS (SELECT src, dst, slot FROM adj WHERE src IN (SELECT cell_id FROM cells WHERE water)
  AND dst IN (SELECT cell_id FROM cells WHERE water))"""
SQL["field"] = f"""field AS (SELECT cell_id, t, CASE WHEN m = 50 THEN 'NaN'::DOUBLE ELSE 5.0::DOUBLE + q / 2 END AS temperature,
  n * 4 AS salinity, m / 5 AS oxygen, (q - 25) / 50 AS u, (n - 4) / 8 AS v FROM (
  SELECT l_partkey AS cell_id, (datediff('day', DATE '1995-01-01', l_shipdate::DATE) % {FIELD_STEPS})::INTEGER AS t,
   avg(l_quantity) AS q, avg(l_linenumber) AS n, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2))"""
SQL["agents"] = f"""agents AS (SELECT c_custkey AS agent_id,
  (CASE WHEN c_custkey % 29 = 0 THEN -1 ELSE c_custkey - c_custkey % 4 END)::BIGINT AS cell,
  3000.0::DOUBLE + c_acctbal / 10 AS mass_g, 3.5::DOUBLE + (c_acctbal + 1000) / 2000 AS ed_kJ_g,
  ({sql_case('c_mktsegment', SEGMENTS)})::INTEGER AS behavior, c_acctbal > -500 AS alive, c_custkey % 10 = 3 AS arrived,
  (c_custkey % 2)::INTEGER AS origin, (c_custkey % 6 - 1)::INTEGER AS natal, c_nationkey::INTEGER AS nation,
  (c_nationkey - 1)::INTEGER AS group_id, c_acctbal AS acc1, (c_custkey % 720)::INTEGER AS steps,
  (c_custkey % 4)::INTEGER AS stage, ([-1, 1, 2, 3][c_custkey % 4 + 1])::INTEGER AS sea_age FROM customer)"""
SQL["predators"] = "predators AS (SELECT s_suppkey AS agent_id, s_nationkey::BIGINT AS cell, s_acctbal > 0 AS alive, s_acctbal AS acc1 FROM supplier)"
SQL["prey"] = "prey AS (SELECT c_custkey AS agent_id, c_nationkey::BIGINT AS cell, c_acctbal > 0 AS alive FROM customer)"
SQL["segments"] = "segments AS (SELECT c_custkey AS segment_id, 50.0::DOUBLE + abs(c_acctbal) / 100 AS length FROM customer)"
SQL["network"] = """network AS (SELECT c_custkey AS src, (c_custkey - 1) // 3 AS dst FROM customer WHERE c_custkey > 0
  UNION ALL SELECT c_custkey, (c_custkey - 1) // 2 FROM customer WHERE c_custkey > 5 AND c_custkey % 5 = 0)"""
SQL["ranges"] = "ranges AS (SELECT l_partkey AS cell_id, min(l_suppkey) AS owner FROM lineitem GROUP BY 1 HAVING max(l_quantity) >= 50)"
SQL["genotypes"] = f"""loci(locus_idx, locus, n_alleles, position_cm) AS (VALUES {', '.join(f"({i},'{n}',{k},{c}::DOUBLE)" for i, (n, k, c) in enumerate(LOCI))}),
genotypes AS (SELECT c_custkey AS agent_id, locus_idx, locus, n_alleles, position_cm,
  floor({sql_u('allele0', 'c_custkey', 'locus_idx')} * n_alleles)::INTEGER AS a0,
  floor({sql_u('allele1', 'c_custkey', 'locus_idx')} * n_alleles)::INTEGER AS a1 FROM customer CROSS JOIN loci)"""
SQL["runs"] = """runs AS (SELECT (o_custkey % 5)::INTEGER AS run_id, (datediff('day', DATE '1995-01-01', o_orderdate::DATE) // 30)::INTEGER AS step,
  count(*) AS size, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_arrived FROM orders GROUP BY 1, 2)"""

NEEDS = {"adj": ["cells"], "edges": ["cells", "adj"]}


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the named views in dependency order."""
    order: list[str] = []
    for n in names:
        for dep in [*NEEDS.get(n, []), n]:
            if dep not in order:
                order.append(dep)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in order) + "\n"
