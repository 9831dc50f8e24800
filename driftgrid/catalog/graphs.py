"""Queries for graph and territory operators."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.operators import graph as g
from driftgrid.operators import territories as ter
from driftgrid.plans import star
from driftgrid.plans.star import SEED, WIDTH, sql_u, with_views


@query("grf1_reachable_downstream", with_views("network", recursive=True) + """, r(seed, node) AS (SELECT src, dst FROM network UNION SELECT r.seed, n.dst FROM r JOIN network n ON n.src = r.node)
  SELECT seed, node FROM r""")
def grf1(spark, d):
    seeds = star.segments(spark, d).select(F.col("segment_id").alias("seed"))
    return g.reachable(star.network(spark, d), seeds)


@query("grf1_reachable_upstream", with_views("network", recursive=True) + """, r(seed, node) AS (SELECT dst, src FROM network WHERE dst IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) UNION SELECT r.seed, n.src FROM r JOIN network n ON n.dst = r.node)
  SELECT seed, node FROM r""")
def grf1u(spark, d):
    seeds = star.table(spark, d, "customer").filter("c_acctbal > 8000").select(F.col("c_custkey").alias("seed"))
    return g.reachable(star.network(spark, d), seeds, "upstream")


@query("grf2_headwaters_outlets", with_views("segments", "network") + """SELECT segment_id, 'headwater' AS kind FROM segments WHERE segment_id NOT IN (SELECT dst FROM network)
  UNION ALL SELECT segment_id, 'outlet' FROM segments WHERE segment_id NOT IN (SELECT src FROM network)""")
def grf2(spark, d):
    s, n = star.segments(spark, d), star.network(spark, d)
    return (g.headwaters(s, n).select("segment_id", F.lit("headwater").alias("kind"))
            .unionByName(g.outlets(s, n).select("segment_id", F.lit("outlet").alias("kind"))))


@query("grf3_distance_from_sources", with_views("edges", recursive=True) + """, we AS (SELECT src, dst, 1 + a.level + b.level AS w FROM edges JOIN cells a ON src = a.cell_id JOIN cells b ON dst = b.cell_id),
  bf(cell_id, d) USING KEY (cell_id) AS (SELECT cell_id, 0 FROM cells WHERE water AND depth >= 48
   UNION SELECT we.dst, min(bf.d + w) FROM bf JOIN we ON we.src = bf.cell_id LEFT JOIN recurring.bf k ON k.cell_id = we.dst WHERE k.cell_id IS NULL OR bf.d + w < k.d GROUP BY we.dst)
  SELECT c.cell_id, CASE WHEN NOT water THEN 'NaN'::DOUBLE WHEN d IS NULL THEN 'Infinity'::DOUBLE ELSE d END AS dist FROM cells c LEFT JOIN bf ON bf.cell_id = c.cell_id""")
def grf3(spark, d):
    c = star.cells(spark, d)
    lv = c.select("cell_id", "level")
    e = (star.edges(spark, d).join(lv.select(F.col("cell_id").alias("src"), F.col("level").alias("a")), "src")
         .join(lv.select(F.col("cell_id").alias("dst"), F.col("level").alias("b")), "dst").withColumn("weight", (F.col("a") + F.col("b") + 1).cast("double")))
    return g.distance_from_sources(c, e, c.filter("water and depth >= 48"))


SQL_COMP = """, ce AS (SELECT src, dst FROM edges JOIN cells a ON src = a.cell_id JOIN cells b ON dst = b.cell_id WHERE a.region_id = b.region_id),
  r(n, m) AS (SELECT cell_id, cell_id FROM cells UNION SELECT r.n, ce.dst FROM r JOIN ce ON ce.src = r.m), lab AS (SELECT n AS cell_id, min(m) AS component FROM r GROUP BY 1)
"""


@query("grf4_components", with_views("edges", recursive=True) + SQL_COMP + "SELECT cell_id, component FROM lab")
def grf4(spark, d):
    return g.components(star.cells(spark, d), star.edges(spark, d), "region_id")


@query("grf4_component_counts", with_views("edges", recursive=True) + SQL_COMP + """SELECT region_id, count(*) AS components, max(n) AS largest FROM (SELECT region_id, component, count(*) AS n FROM lab JOIN cells USING (cell_id) GROUP BY 1, 2) GROUP BY 1""")
def grf4c(spark, d):
    c = star.cells(spark, d)
    return g.component_counts(c, g.components(c, star.edges(spark, d), "region_id"), "region_id")


SQL_GAPS = with_views("cells", recursive=True) + f""", land AS (SELECT cell_id, r, c, c - floor((r - r % 2) / 2)::BIGINT AS q FROM cells WHERE depth > 25),
  near AS (SELECT a.cell_id AS src, b.cell_id AS dst FROM land a JOIN land b ON a.cell_id <> b.cell_id AND abs(a.q - b.q) <= 1 AND abs(a.r - b.r) <= 1 AND abs(a.q - b.q + a.r - b.r) <= 1),
  reach(n, m) AS (SELECT cell_id, cell_id FROM land UNION SELECT reach.n, near.dst FROM reach JOIN near ON near.src = reach.m),
  lab AS (SELECT n AS cell_id, min(m) AS component FROM reach GROUP BY 1),
  home AS (SELECT component FROM lab GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
  spot AS (SELECT l.*, component, component = (SELECT component FROM home) AS home FROM land l JOIN lab USING (cell_id)),
  pr AS (SELECT o.component, greatest(abs(o.q - h.q), abs(o.r - h.r), abs(o.q - h.q + o.r - h.r)) AS hops, o.q AS oq, o.r AS orr, h.q, h.r FROM spot o JOIN spot h ON NOT o.home AND h.home),
  best AS (SELECT * FROM pr WHERE hops <= 4 QUALIFY row_number() OVER (PARTITION BY component ORDER BY hops, oq, orr, q, r) = 1),
  ln AS (SELECT oq + 1e-6::DOUBLE + (q - oq) * (i / hops) AS fq, orr + 2e-6::DOUBLE + (r - orr) * (i / hops) AS fr FROM (SELECT *, unnest(range(0, hops + 1)) AS i FROM best)),
  rd AS (SELECT *, floor(fq + 0.5) AS a, floor(fr + 0.5) AS b, floor(-fq - fr + 0.5) AS c FROM ln),
  dd AS (SELECT *, abs(a - fq) AS da, abs(b - fr) AS db, abs(c + fq + fr) AS dc FROM rd),
  hx AS (SELECT (CASE WHEN da > db AND da > dc THEN -b - c ELSE a END)::BIGINT AS hq, (CASE WHEN NOT (da > db AND da > dc) AND db > dc THEN -a - c ELSE b END)::BIGINT AS hr FROM dd)
  SELECT DISTINCT hr AS row, hq + (hr - ((hr % 2) + 2) % 2) // 2 AS col FROM hx WHERE NOT EXISTS (SELECT 1 FROM land WHERE land.r = hr AND land.c = hq + (hr - ((hr % 2) + 2) % 2) // 2)"""


@query("grf5_bridge_gaps", SQL_GAPS)
def grf5(spark, d):
    c = star.cells(spark, d).filter("depth > 25").select("cell_id", "row", "col")
    e = star.hex_adjacency(c, WIDTH)
    return g.bridge_gaps(c, g.components(c, e), 4)


@query("grf9_edge_adjacency", with_views("cells") + """, tr AS (SELECT cell_id * 2 AS tri, r * 41 + c AS n0, r * 41 + c + 1 AS n1, (r + 1) * 41 + c AS n2 FROM cells UNION ALL SELECT cell_id * 2 + 1, r * 41 + c + 1, (r + 1) * 41 + c + 1, (r + 1) * 41 + c FROM cells),
  sd AS (SELECT tri, 0 AS slot, least(n0, n1) AS a, greatest(n0, n1) AS b FROM tr UNION ALL SELECT tri, 1, least(n1, n2), greatest(n1, n2) FROM tr UNION ALL SELECT tri, 2, least(n2, n0), greatest(n2, n0) FROM tr)
  SELECT x.tri, x.slot, min(y.tri) AS neighbour FROM sd x JOIN sd y ON x.a = y.a AND x.b = y.b AND x.tri <> y.tri GROUP BY 1, 2""")
def grf9(spark, d):
    return g.edge_adjacency(triangles(spark, d))


def triangles(spark, d):
    """Two triangles per grid cell on a 41-column node lattice."""
    def node(dr, dc):
        return (F.col("row") + dr) * (WIDTH + 1) + F.col("col") + dc
    two = F.array(F.struct(F.lit(0).alias("k"), node(0, 0).alias("n0"), node(0, 1).alias("n1"), node(1, 0).alias("n2")),
                  F.struct(F.lit(1).alias("k"), node(0, 1).alias("n0"), node(1, 1).alias("n1"), node(1, 0).alias("n2")))
    return star.cells(spark, d).select("cell_id", F.explode(two).alias("t")).select((F.col("cell_id") * 2 + F.col("t.k")).alias("tri"), "t.n0", "t.n1", "t.n2")


@query("grf10_gradient", with_views("edges") + """, n AS (SELECT src, b.dist - a.dist AS df, b.y - a.y AS dy, b.x - a.x AS dx FROM edges JOIN cells a ON src = a.cell_id JOIN cells b ON dst = b.cell_id),
  s AS (SELECT src, sum(df * dy / sqrt(dy * dy + dx * dx)) AS uy, sum(df * dx / sqrt(dy * dy + dx * dx)) AS ux, sum(df * dy) AS my, sum(df * dx) AS mx FROM n GROUP BY 1)
  SELECT cell_id, round(CASE WHEN uy * uy + ux * ux > 1e-20 THEN uy / sqrt(uy * uy + ux * ux) ELSE 0 END, 6) + 0.0 AS unit_y, round(CASE WHEN uy * uy + ux * ux > 1e-20 THEN ux / sqrt(uy * uy + ux * ux) ELSE 0 END, 6) + 0.0 AS unit_x,
  round(CASE WHEN my * my + mx * mx > 1e-20 THEN my / sqrt(my * my + mx * mx) ELSE 0 END, 6) + 0.0 AS metric_y, round(CASE WHEN my * my + mx * mx > 1e-20 THEN mx / sqrt(my * my + mx * mx) ELSE 0 END, 6) + 0.0 AS metric_x
  FROM cells LEFT JOIN s ON src = cell_id""")
def grf10(spark, d):
    c, e = star.cells(spark, d), star.edges(spark, d)
    def r(x):
        return F.round(x, 6) + 0.0
    u = g.gradient(c, e, "dist", least=1e-10).select("cell_id", r("gy").alias("unit_y"), r("gx").alias("unit_x"))
    m = g.gradient(c, e, "dist", "metric", least=1e-10).select("cell_id", r("gy").alias("metric_y"), r("gx").alias("metric_x"))
    return u.join(m, "cell_id")


SQL_POS = with_views("segments", "network") + f""", p AS (SELECT o_orderkey AS agent_id, o_custkey AS segment_id, (o_totalprice / 500000) * length AS "offset", length, 20.0::DOUBLE + o_orderkey % 60 AS step
   FROM orders JOIN segments ON segment_id = o_custkey)
"""


def positions(spark, d):
    s = star.segments(spark, d)
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("agent_id"), F.col("o_custkey").alias("segment_id"), "o_totalprice").join(s, "segment_id")
    return o.select("agent_id", "segment_id", ((F.col("o_totalprice") / 500000) * F.col("length")).alias("offset"), (F.lit(20.0) + F.col("agent_id") % 60).alias("step"))


def sql_move(up):
    a, b = ("dst", "src") if up else ("src", "dst")
    raw = '"offset" - step' if up else '"offset" + step'
    ok = "raw >= 0" if up else "raw <= p.length"
    over = "-raw" if up else "raw - p.length"
    ent = "greatest(n.length - over, 0)" if up else "least(over, n.length)"
    return SQL_POS + f""", nx AS (SELECT {a} AS sid, {b} AS nid, row_number() OVER (PARTITION BY {a} ORDER BY {b}) AS k, count(*) OVER (PARTITION BY {a}) AS cnt FROM (SELECT DISTINCT src, dst FROM network)),
  q AS (SELECT *, {over.replace('p.', '')} AS over, ({ok.replace('p.', '')}) AS ok FROM (SELECT *, {raw} AS raw FROM p)),
  z AS (SELECT q.*, nid FROM q LEFT JOIN nx ON NOT ok AND sid = q.segment_id AND k = least(floor({sql_u('branch', 'agent_id')} * cnt), cnt - 1) + 1)
  SELECT agent_id, CASE WHEN ok THEN z.segment_id ELSE coalesce(nid, z.segment_id) END AS segment_id,
  round(CASE WHEN ok THEN raw WHEN nid IS NOT NULL THEN {ent} ELSE {'0' if up else 'z.length'} END, 6)::DOUBLE AS "offset" FROM z LEFT JOIN segments n ON n.segment_id = nid"""


@query("grf13_move_upstream", sql_move(True))
def grf13u(spark, d):
    out = g.move_along_network(positions(spark, d), star.segments(spark, d), star.network(spark, d), "step", SEED, "upstream")
    return out.withColumn("offset", F.round("offset", 6))


@query("grf13_move_downstream", sql_move(False))
def grf13d(spark, d):
    out = g.move_along_network(positions(spark, d), star.segments(spark, d), star.network(spark, d), "step", SEED, "downstream")
    return out.withColumn("offset", F.round("offset", 6))


@query("grf14_network_range_length", with_views("segments") + """, rg AS (SELECT segment_id AS id, (segment_id - 1) // 3 AS p, length FROM segments WHERE segment_id > 0)
  SELECT id AS range_id, round(CASE WHEN p = 0 THEN rg.length - 5.0 + 2.5 WHEN p > 0 THEN rg.length - 5.0 + s.length + 2.5 END, 6)::DOUBLE AS total_length FROM rg LEFT JOIN segments s ON s.segment_id = p AND p > 0
  UNION ALL SELECT 0, -2.5""")
def grf14(spark, d):
    """Each range runs from a segment through its parent to the outlet."""
    s = star.segments(spark, d)
    zero = F.lit(0).cast("long")
    path = (F.when(F.col("segment_id") == 0, F.array(zero)).when(F.expr("(segment_id - 1) div 3") == 0, F.array("segment_id", zero))
            .otherwise(F.array(F.col("segment_id"), F.expr("(segment_id - 1) div 3"), zero)))
    r = s.select(F.col("segment_id").alias("range_id"), path.alias("segments"), F.lit(5.0).alias("start_offset"), F.lit(2.5).alias("end_offset"))
    return g.network_range_length(r, s).withColumn("total_length", F.round("total_length", 6))


SQL_CAND = with_views("ranges", "edges") + """, ow AS (SELECT owner, count(*) AS n FROM ranges GROUP BY 1 HAVING count(*) < 15),
  cand AS (SELECT DISTINCT r.owner, dst AS cell_id, resource AS worth, 15 - n AS room FROM ranges r JOIN ow USING (owner) JOIN edges ON src = r.cell_id JOIN cells c ON c.cell_id = dst
   WHERE resource >= 2 AND dst NOT IN (SELECT cell_id FROM ranges))
"""


@query("grf15_expansion_candidates", SQL_CAND + "SELECT owner, cell_id, worth, room FROM cand")
def grf15c(spark, d):
    return ter.expansion_candidates(star.ranges(spark, d), star.edges(spark, d), star.cells(spark, d), "resource", 2.0, 15)


SQL_EXPAND = SQL_CAND.replace("WITH ", "WITH RECURSIVE ", 1) + """, turn AS (SELECT owner, max(room) AS room, list(cell_id ORDER BY worth DESC, cell_id) AS l, row_number() OVER (ORDER BY owner) AS k FROM cand GROUP BY 1),
  served(k, owner, pick, taken) AS (SELECT 0::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
   SELECT k, owner, pick, list_concat(taken, pick) FROM (SELECT t.k, t.owner, list_filter(t.l, lambda x: NOT list_contains(s.taken, x))[1:t.room] AS pick, s.taken FROM served s JOIN turn t ON t.k = s.k + 1))
  SELECT owner, unnest(pick) AS cell_id FROM served WHERE k > 0"""


@query("grf15_expand_ranges", SQL_EXPAND)
def grf15(spark, d):
    return ter.expand_ranges(star.ranges(spark, d), star.edges(spark, d), star.cells(spark, d), "resource", 2.0, 15)


@query("grf16_contract_ranges", with_views("ranges", "cells") + "SELECT owner, cell_id FROM ranges WHERE cell_id NOT IN (SELECT cell_id FROM cells WHERE resource < 3)")
def grf16(spark, d):
    return ter.contract_ranges(star.ranges(spark, d), star.cells(spark, d), "resource", 3.0).select("owner", "cell_id")


@query("grf16_release", with_views("ranges") + "SELECT owner, cell_id FROM ranges WHERE owner NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def grf16r(spark, d):
    gone = star.table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("owner"))
    return ter.release(star.ranges(spark, d), gone).select("owner", "cell_id")


@query("grf17_line_crossings", with_views("cells") + """, ln AS (SELECT s_suppkey AS id, s_nationkey * 2.5 + 0.137::DOUBLE AS x1, 0.211::DOUBLE + s_suppkey % 50 AS y1, (s_acctbal + 1000) / 200 AS x2, 3.3::DOUBLE + s_nationkey * 2 AS y2 FROM supplier),
  n AS (SELECT *, greatest(16, floor(4.0 * sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))))::BIGINT AS n FROM ln),
  pt AS (SELECT id, i, x1 + (i / (n - 1)) * (x2 - x1) AS px, y1 + (i / (n - 1)) * (y2 - y1) AS py FROM n, range(0, 1000) t(i) WHERE i < n),
  fr AS (SELECT id, i, sqrt(3.0::DOUBLE) / 3.0 * px - (1.0::DOUBLE / 3.0) * py AS q, (2.0::DOUBLE / 3.0) * py AS r FROM pt),
  rd AS (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM fr),
  hx AS (SELECT id, i, (CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN -rr - rs ELSE rq END)::BIGINT AS hq,
    (CASE WHEN NOT (abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r)) AND abs(rr - r) > abs(rs + q + r) THEN -rq - rs ELSE rr END)::BIGINT AS hr FROM rd),
  mv AS (SELECT id, hq, hr, lag(hq) OVER (PARTITION BY id ORDER BY i) AS pq, lag(hr) OVER (PARTITION BY id ORDER BY i) AS pr FROM hx),
  ok AS (SELECT DISTINCT pr * 40 + pq + (pr - (pr % 2 + 2) % 2) // 2 AS src, hr * 40 + hq + (hr - (hr % 2 + 2) % 2) // 2 AS dst, pr, hr, pq + (pr - (pr % 2 + 2) % 2) // 2 AS pc, hq + (hr - (hr % 2 + 2) % 2) // 2 AS hc FROM mv
   WHERE pq IS NOT NULL AND greatest(abs(hq - pq), abs(hr - pr), abs(hq - pq + hr - pr)) = 1),
  bt AS (SELECT src, dst FROM ok WHERE pc BETWEEN 0 AND 39 AND hc BETWEEN 0 AND 39 AND pr >= 0 AND hr >= 0 AND src IN (SELECT cell_id FROM cells) AND dst IN (SELECT cell_id FROM cells))
  SELECT src, dst FROM bt UNION SELECT dst, src FROM bt""")
def grf17(spark, d):
    s = star.table(spark, d, "supplier")
    lines = s.select(F.col("s_suppkey").alias("line_id"), (F.col("s_nationkey") * 2.5 + 0.137).alias("x1"), (F.lit(0.211) + F.col("s_suppkey") % 50).alias("y1"),
                     ((F.col("s_acctbal") + 1000) / 200).alias("x2"), (F.lit(3.3) + F.col("s_nationkey") * 2).alias("y2"))
    return g.line_crossings(lines, star.cells(spark, d))


@query("grf18_cross_level_adjacency", with_views("cells") + """, m AS (SELECT cell_id, 5 - level AS lv, c, r, level FROM cells),
  k AS (SELECT DISTINCT lv, c // (1 << level) AS x, r // (1 << level) AS y, min(cell_id) AS id FROM m GROUP BY 1, 2, 3),
  rg AS (SELECT id AS src, lv, x + a AS x, y + b AS y FROM k, (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) s(b) WHERE NOT (a = 0 AND b = 0)),
  gp AS (SELECT * FROM rg WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.lv = rg.lv AND k.x = rg.x AND k.y = rg.y)),
  cr AS (SELECT src, k.id AS dst FROM gp JOIN (VALUES (1), (2), (3)) u(d) ON true JOIN k ON k.lv = gp.lv - d AND k.x = floor(gp.x / (1 << d)) AND k.y = floor(gp.y / (1 << d)) QUALIFY row_number() OVER (PARTITION BY src, gp.lv, gp.x, gp.y ORDER BY d) = 1),
  fn AS (SELECT gp.src, k.id AS dst FROM k JOIN (VALUES (1), (2), (3)) u(d) ON true JOIN gp ON gp.lv = k.lv - d AND gp.x = k.x // (1 << d) AND gp.y = k.y // (1 << d))
  SELECT DISTINCT src, dst FROM (SELECT src, k.id AS dst FROM rg JOIN k ON k.lv = rg.lv AND k.x = rg.x AND k.y = rg.y UNION ALL SELECT src, dst FROM cr UNION ALL SELECT src, dst FROM fn) WHERE src <> dst""")
def grf18(spark, d):
    """Cells fold into level 5 - level blocks, which gives a mixed grid with missing positions."""
    c = star.cells(spark, d)
    k = (c.groupBy((F.lit(5) - F.col("level")).alias("level"), F.expr("col div (1 << level)").cast("long").alias("x"), F.expr("row div (1 << level)").cast("long").alias("y"))
         .agg(F.min("cell_id").alias("cell_id")))
    return g.cross_level_adjacency(k)
