"""Streaming queries: the whole events table is replayed as a stream and drained into a table."""

from pyspark.sql import functions as F

from driftgrid.catalog.base import query
from driftgrid.operators import reports as rep
from driftgrid.plans import star
from driftgrid.plans.star import hour_of, with_views
from driftgrid.streaming import state, windows
from driftgrid.streaming.source import MARKER, hourly_steps, marker_folder, positions, replay, run_to_table

P = with_views("positions")
# One row per individual and hour: its last event.
STEPS = "positions AS (SELECT * FROM every_position QUALIFY row_number() OVER (PARTITION BY agent_id, hour ORDER BY ts DESC, event_id DESC) = 1)"
S = with_views("positions").replace("positions AS", "every_position AS", 1).rstrip() + ", " + STEPS + "\n"
SC = with_views("positions", "cells").replace("positions AS", "every_position AS", 1).rstrip() + ", " + STEPS + "\n"
W = "WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def drained(spark, d, build, label):
    """The table that build makes of all events, replayed as a stream; a pattern reads a file or a folder alike."""
    marker = marker_folder(spark)
    return run_to_table(build(positions(spark, f"{d}/events.parque[t]", marker=marker)), label, marker=marker)


# Filters run before the watermark is taken, so they let the end marker through.
def end():
    return F.col("agent_id") == MARKER


def real(df):
    return df.filter(F.col("agent_id") != MARKER)


@query("str1_step_summary", P + "SELECT hour, count(*) FILTER (alive) AS n_alive, count(*) FILTER (arrived) AS n_arrived, round(coalesce(avg(ed_kJ_g) FILTER (alive), 0), 9) AS mean_ed, " +
       ", ".join(f"count(*) FILTER (alive AND behavior = {b}) AS behavior_{b}" for b in range(5)) + " FROM positions GROUP BY 1")
def str1(spark, d):
    out = drained(spark, d, windows.step_summaries, "summary")
    return out.select(hour_of("start").cast("int").alias("hour"), "n_alive", "n_arrived", F.round("mean_ed", 9).alias("mean_ed"), *[f"behavior_{b}" for b in range(5)])


@query("str2_rolling_mean", P + """, act AS (SELECT *, CASE WHEN alive AND NOT arrived THEN (mass_g + coalesce(lag(mass_g) OVER v, 15.0) + coalesce(lag(mass_g, 2) OVER v, 15.0)) / 3.0 END AS m
   FROM positions WINDOW v AS (PARTITION BY agent_id, alive AND NOT arrived ORDER BY ts, event_id))
  SELECT agent_id, event_id, round(coalesce(last_value(m IGNORE NULLS) OVER w, 15.0), 6)::DOUBLE AS mean3 FROM act """ + W)
def str2(spark, d):
    """Every event is a sample, also those that share an hour; one without a time or an individual has no place in the order."""
    placed = F.col("ts").isNotNull() & F.col("agent_id").isNotNull()
    return real(drained(spark, d, lambda s: state.rolling_mean(s.filter(placed), "mass_g"), "rolling")).withColumn("mean3", F.round("mean3", 6))


@query("str3_residence", S + """, a AS (SELECT *, alive AND NOT arrived AS act, behavior = 2 AS s, sum((alive AND NOT arrived)::INT) OVER w AS rn FROM positions """ + W + """),
  b AS (SELECT *, last_value(CASE WHEN act THEN s END IGNORE NULLS) OVER w AS st, max(CASE WHEN act AND s THEN rn END) OVER w AS li, max(CASE WHEN act AND NOT s THEN rn END) OVER w AS lo FROM a """ + W + """)
  SELECT agent_id, event_id, (CASE WHEN st THEN rn - coalesce(lo, 0) ELSE 0 END)::BIGINT AS hours_in, (CASE WHEN st THEN 0 WHEN li IS NULL THEN 999 + rn ELSE rn - li END)::BIGINT AS steps_since FROM b""")
def str3(spark, d):
    return real(drained(spark, d, lambda s: state.residence(hourly_steps(s), F.col("behavior") == 2), "residence"))


@query("str3_sessions", P + """, s AS (SELECT agent_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM positions WHERE behavior = 2 WINDOW w AS (PARTITION BY agent_id ORDER BY ts)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY agent_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
  SELECT agent_id, (datediff('second', TIMESTAMP '2024-01-01', date_trunc('second', min(ts))) // 3600)::INTEGER AS start_hour, count(*) AS n FROM g GROUP BY agent_id, k""")
def str3s(spark, d):
    out = real(drained(spark, d, lambda s: windows.sessions(s, (F.col("behavior") == 2) | end()), "sessions"))
    return out.select("agent_id", hour_of("start").cast("int").alias("start_hour"), "n")


@query("str4_sticky_flags", SC + f""", r AS (SELECT p.*, coalesce(region_id, -1) AS region, dist FROM positions p LEFT JOIN cells ON cell = cell_id),
  thr AS (SELECT region_id, quantile_cont(dist, 0.75) FILTER (water) - 1e-9 AS threshold FROM cells WHERE region_id >= 0 GROUP BY 1),
  n AS (SELECT r.*, first_value(region) OVER w AS natal FROM r {W}),
  e AS (SELECT n.*, bool_or(alive AND region IN (0, 4)) OVER w AS ever, alive AND natal >= 0 AND region = natal AND dist >= threshold AS up FROM n LEFT JOIN thr ON region_id = natal {W})
  SELECT agent_id, event_id, coalesce(first_value(CASE WHEN alive AND region IN (1, 3) THEN region END IGNORE NULLS) OVER w, -1) AS tag, ever AS ever_in, coalesce(bool_or(up AND ever) OVER w, false) AS arrived FROM e {W}""")
def str4(spark, d):
    c = star.cells(spark, d)
    thr = rep.region_thresholds(c).withColumn("threshold", F.col("threshold") - 1e-9)
    return real(drained(spark, d, lambda s: state.sticky(hourly_steps(s), c, thr, [1, 3], [0, 4]), "sticky"))


@query("str5_trips", SC + """, p AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS k FROM positions JOIN cells ON cell = cell_id WHERE alive),
  g AS (SELECT agent_id, list(x ORDER BY ts, event_id) AS xs, list(y ORDER BY ts, event_id) AS ys FROM p WHERE k <= 40 GROUP BY 1),
  b AS (SELECT agent_id, behavior FROM positions WHERE alive QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) = 1)
  SELECT agent_id, len(xs)::INTEGER AS points, round(xs[1], 6) AS x0, round(xs[-1], 6) AS x1, round(ys[-1], 6) AS y1, behavior FROM g JOIN b USING (agent_id) WHERE len(xs) >= 2 AND (len(list_distinct(xs)) > 1 OR len(list_distinct(ys)) > 1)""")
def str5(spark, d):
    out = real(drained(spark, d, lambda s: state.trips(hourly_steps(s), star.cells(spark, d)), "trips"))
    last = out.groupBy("agent_id").agg(F.max_by(F.struct("xs", "ys", "behavior", "moved"), "at").alias("s")).select("agent_id", "s.*").filter("moved")
    return last.select("agent_id", F.size("xs").alias("points"), F.round(F.get("xs", F.lit(0)), 6).alias("x0"), F.round(F.element_at("xs", -1), 6).alias("x1"),
                       F.round(F.element_at("ys", -1), 6).alias("y1"), "behavior")


@query("str6_co_located", P + """SELECT hour, cell, count(*) FILTER (agent_id % 2 = 0) AS n_a, count(*) FILTER (agent_id % 2 = 1) AS n_b FROM positions GROUP BY 1, 2
  HAVING count(*) FILTER (agent_id % 2 = 0) > 0 AND count(*) FILTER (agent_id % 2 = 1) > 0""")
def str6(spark, d):
    def shared(s):
        return windows.co_located(*(s.filter((F.col("agent_id") % 2 == k) | end()) for k in (0, 1)))
    return drained(spark, d, shared, "shared").select(hour_of("start").cast("int").alias("hour"), "cell", "n_a", "n_b")


@query("str7_tallies", P + "SELECT cell AS cell_id, count(DISTINCT hour) AS steps, count(*) AS n FROM positions WHERE alive GROUP BY 1")
def str7(spark, d):
    return windows.occupancy_density(drained(spark, d, windows.tallies, "tallies"))


@query("str7_flux", S + """, m AS (SELECT cell, old FROM (SELECT *, lag(cell) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS old FROM positions) WHERE alive AND old IS NOT NULL AND old <> cell)
  SELECT cell_id, sum(d)::BIGINT AS net FROM (SELECT cell AS cell_id, 1 AS d FROM m UNION ALL SELECT old, -1 FROM m) GROUP BY 1""")
def str7f(spark, d):
    return windows.flux(real(drained(spark, d, lambda s: state.moves(hourly_steps(s)), "moves")))


@query("str8_late_rows", P + """, w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM positions WHERE event_id % 10 <> 0 AND hour < (SELECT max(hour) FROM positions))
  SELECT hour, count(*) AS n FROM positions, w WHERE event_id % 10 <> 0 OR TIMESTAMP '2024-01-01' + to_hours(hour + 1) > mark GROUP BY 1""")
def str8(spark, d):
    """Every tenth event arrives after all others: those whose hour the watermark closed are dropped."""
    e = star.table(spark, d, "events")
    last = e.select(hour_of("ts").alias("h")).agg(F.max("h")).first()[0]
    early, on_time = hour_of("ts") < last, F.col("event_id") % 10 != 0
    out = replay(spark, [e.filter(on_time & early), e.filter(on_time & ~early), e.filter(~on_time)], windows.counts, "late")
    return out.select(hour_of("start").cast("int").alias("hour"), "n")
