"""Queries for spatial sampling."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.catalog.graphs import triangles
from driftgrid.operators import reports as rep
from driftgrid.operators import spatial as spa
from driftgrid.plans import star
from driftgrid.plans.star import with_views

# Outlines in grid units: a box with a hole, a triangle over it, and a slanted quad.
RINGS = [
    (3, 1, 0, [(5.1, 3.2), (45.3, 3.2), (45.3, 40.7), (5.1, 40.7)]), (3, 1, 1, [(15.2, 12.1), (30.4, 12.1), (30.4, 25.3), (15.2, 25.3)]),
    (1, 0, 0, [(20.3, 1.1), (60.2, 30.4), (10.7, 35.6)]), (4, 2, 0, [(40.1, 30.2), (70.3, 50.1), (55.4, 75.3), (35.2, 60.8)])]


def rings(spark, only=None):
    rows = [(region, prio, ring, k, x, y) for region, prio, ring, pts in RINGS for k, (x, y) in enumerate(pts) if only is None or region in only]
    return spark.createDataFrame(rows, "region int, priority int, ring int, seq int, x double, y double")


def _sql_sides():
    out = []
    for region, prio, _ring, pts in RINGS:
        for a, b in zip(pts, pts[1:] + pts[:1]):
            out.append(f"({region},{prio},{a[0]}::DOUBLE,{a[1]}::DOUBLE,{b[0]}::DOUBLE,{b[1]}::DOUBLE)")
    return "sides(region, prio, x1, y1, x2, y2) AS (VALUES " + ", ".join(out) + ")"


SQL_IN = f""", {_sql_sides()}, inn AS (SELECT cell_id, region, prio FROM cells JOIN sides ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
"""


def cell_points(spark, d):
    return star.cells(spark, d).select(F.col("cell_id").alias("point_id"), "x", "y", "water")


@query("spa1_point_in_polygon", with_views("cells") + SQL_IN + """SELECT cell_id AS point_id, CASE WHEN NOT water THEN -1 ELSE coalesce(region, 9) END AS region FROM cells
  LEFT JOIN (SELECT cell_id, arg_min(region, prio) AS region FROM inn GROUP BY 1) USING (cell_id)""")
def spa1(spark, d):
    return spa.point_in_polygon(cell_points(spark, d), rings(spark), 9)


@query("agg22_agreement_share", with_views("cells") + SQL_IN + """, f AS (SELECT cell_id IN (SELECT cell_id FROM inn WHERE region = 3) AS a, cell_id IN (SELECT cell_id FROM inn WHERE region IN (1, 4)) AS b FROM cells)
  SELECT count(*) AS n, count(*) FILTER (a) AS in_a, count(*) FILTER (b) AS in_b, count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS either, count(*) FILTER (NOT a AND NOT b) AS neither,
  count(*) FILTER (a) / count(*) AS share_in_a, count(*) FILTER (b) / count(*) AS share_in_b, count(*) FILTER (a AND b) / count(*) AS share_both, count(*) FILTER (a OR b) / count(*) AS share_either,
  count(*) FILTER (NOT a AND NOT b) / count(*) AS share_neither FROM f""")
def agg22(spark, d):
    p = spa.inside_any(cell_points(spark, d), rings(spark, {3}), "a")
    return rep.agreement_share(spa.inside_any(p, rings(spark, {1, 4}), "b"), "a", "b")


SQL_GRID = """WITH grid AS (SELECT p_size - 1 AS gi, substr(p_brand, 7)::BIGINT - 1 AS gj, max(p_retailprice) AS value FROM part GROUP BY 1, 2),
  pt AS (SELECT c_custkey AS point_id, 10 + (c_acctbal + 1200) / 220 AS lat, 20 + (c_custkey * 37 % 1009) / 80.0::DOUBLE AS lon FROM customer)
"""


def grid(spark, d):
    p = star.table(spark, d, "part")
    return p.groupBy((F.col("p_size") - 1).cast("long").alias("gi"), (F.substring("p_brand", 7, 9).cast("long") - 1).alias("gj")).agg(F.max("p_retailprice").alias("value"))


def grid_points(spark, d):
    c = star.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("point_id"), (F.lit(10) + (F.col("c_acctbal") + 1200) / 220).alias("lat"), (F.lit(20) + (F.col("c_custkey") * 37 % 1009) / 80.0).alias("lon"))


@query("spa2_bilinear", SQL_GRID + """, b AS (SELECT *, (lat - 10) / 1.0 AS fi, (lon - 20) / 0.5 AS fj FROM pt),
  q AS (SELECT *, least(greatest(floor(fi), 0), 48)::BIGINT AS i, least(greatest(floor(fj), 0), 23)::BIGINT AS j, fi BETWEEN 0 AND 49 AND fj BETWEEN 0 AND 24 AS ok FROM b),
  v AS (SELECT point_id, lat, lon, CASE WHEN ok THEN a.value * (1 - (fi - i)) * (1 - (fj - j)) + b.value * (1 - (fi - i)) * (fj - j) + c.value * (fi - i) * (1 - (fj - j)) + e.value * (fi - i) * (fj - j) END AS val
    FROM q LEFT JOIN grid a ON a.gi = i AND a.gj = j LEFT JOIN grid b ON b.gi = i AND b.gj = j + 1 LEFT JOIN grid c ON c.gi = i + 1 AND c.gj = j LEFT JOIN grid e ON e.gi = i + 1 AND e.gj = j + 1),
  nn AS (SELECT point_id, value AS near FROM v, grid WHERE val IS NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY sqrt(power(20 + gj * 0.5 - lon, 2) + power(10 + gi - lat, 2)), gi * 25 + gj) = 1)
  SELECT point_id, round(coalesce(val, near), 9) AS value FROM v LEFT JOIN nn USING (point_id)""")
def spa2(spark, d):
    out = spa.bilinear(grid_points(spark, d), grid(spark, d), (10.0, 20.0), (1.0, 0.5), (50, 25))
    return out.withColumn("value", F.round("value", 9))


@query("spa3_nearest_raster", SQL_GRID + """SELECT point_id, coalesce(value, 0) AS value FROM pt LEFT JOIN grid ON gi = least(greatest(trunc((60 - lat) / 50 * 49), 0), 49) AND gj = least(greatest(trunc((lon - 20) / 13 * 24), 0), 24)""")
def spa3(spark, d):
    r = grid(spark, d).select(F.col("gi").alias("row"), F.col("gj").alias("col"), "value")
    return spa.nearest_raster(grid_points(spark, d), r, (20.0, 10.0, 33.0, 60.0), (50, 25))


@query("spa6_node_to_cell_mean", with_views("cells") + """, tr AS (SELECT cell_id * 2 AS tri, r * 41 + c AS n0, r * 41 + c + 1 AS n1, (r + 1) * 41 + c AS n2 FROM cells UNION ALL SELECT cell_id * 2 + 1, r * 41 + c + 1, (r + 1) * 41 + c + 1, (r + 1) * 41 + c FROM cells),
  f AS (SELECT l_partkey AS node, l_linenumber AS t, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2), e AS (SELECT tri, unnest([n0, n1, n2]) AS node FROM tr)
  SELECT tri, t, CASE WHEN count(*) = 3 THEN round(avg(value), 6) ELSE 'NaN'::DOUBLE END AS value FROM e JOIN f USING (node) GROUP BY 1, 2""")
def spa6(spark, d):
    f = star.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node"), F.col("l_linenumber").alias("t")).agg(F.avg("l_quantity").alias("value"))
    return spa.node_to_cell_mean(f, triangles(spark, d)).withColumn("value", F.round("value", 6))


@query("spa7_regular_grid", with_views("cells") + """, b AS (SELECT 54.0 + min(y) / 100 AS a0, 54.0 + max(y) / 100 AS a1, 20.0 + min(x) / 100 AS o0, 20.0 + max(x) / 100 AS o1 FROM cells),
  s AS (SELECT *, 1500 / 111000.0::DOUBLE AS da, 1500 / (111000.0::DOUBLE * cos(radians(0.5 * (a0 + a1)))) AS dd FROM b),
  n AS (SELECT *, ceil((a1 + da / 2 - a0) / da)::BIGINT AS ni, ceil((o1 + dd / 2 - o0) / dd)::BIGINT AS nj FROM s)
  SELECT (i * nj + j)::BIGINT AS node, round(a0 + i * da, 8) AS lat, round(o0 + j * dd, 8) AS lon FROM n, range(0, 10000) t(i), range(0, 10000) u(j) WHERE i < ni AND j < nj""")
def spa7(spark, d):
    """The box is the extent of the cells; only its four numbers reach the driver."""
    b = star.cells(spark, d).agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    g = spa.regular_grid(spark, 54.0 + b["loy"] / 100, 20.0 + b["lox"] / 100, 54.0 + b["hiy"] / 100, 20.0 + b["hix"] / 100, 1500.0)
    return g.select("node", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))
