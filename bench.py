"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is timed by materialising its whole result in the no-op sink, after one warm-up query.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "agg1_step_summary", "agg4_census", "agg5_dispersal", "agg7_occupancy", "agg9_flux", "agg14_region_thresholds", "agg15_density_survival",
    "acc12_group_size", "acc21_resources_explored", "acc27_apply_updaters", "trt5_markov_transition", "fn4_update_energy", "fn9_pick_behaviour",
    "join1_sample_field", "join5_kills", "join7_best_neighbour", "join10_flow_neighbour", "join13_barrier_outcome", "join15_nearest_cell",
    "win1_rolling_mean3", "win2_residence_counters", "win6_ever_in", "win7_arrival", "win8_trips", "win9_assign_ids",
    "gen1_reproduce", "gen3_introduce", "gen22_recombine", "grf1_reachable_downstream", "grf3_distance_from_sources", "grf4_components", "grf12_bounded_walk",
    "grf15_expand_ranges", "spa1_point_in_polygon", "spa2_bilinear", "cmp1_compare_census", "cmp3_spatial_jsd", "str1_step_summary", "str2_rolling_mean",
]


COPIES = 160     # copies of the tracks that make about 15.3 million agent-steps at sf0.1


def step_update(spark):
    """Seconds and agent-steps per millisecond of one full state update over copied tracks.

    Field lookup, behaviour draw, overrides and energy balance for every agent-step.
    """
    from pyspark.sql import functions as F

    from driftgrid.catalog.functions import BEHAVIOUR
    from driftgrid.functions import domain as dom
    from driftgrid.operators import energy
    from driftgrid.operators import lookups as lk
    from driftgrid.plans import star

    # The tracks are small before they are copied; spread them so that every core copies a share.
    t = star.tracks(spark, SF_DIR).repartition(4 * int(CPUS)).withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    t = t.withColumn("t", lk.align_time_wrap(F.col("time"), star.FIELD_STEPS))
    t = lk.sample_field(t, star.field(spark, SF_DIR), ["temperature", "salinity"], ("cell", "t"))
    t = t.withColumn("temp", F.coalesce(F.nanvl("temperature", F.lit(15.0)), F.lit(15.0)))
    t = energy.choose_behaviour(t, F.col("temp"), F.lit(720) - F.col("time"), BEHAVIOUR, 1, keys=("run_id", "agent_id", "time"))
    t = t.withColumn("behavior", dom.behaviour_overrides(F.col("behavior"), F.col("time"), F.lit(0), F.lit(999)))
    act = F.get(F.array(*[F.lit(x) for x in (1.0, 1.2, 0.8, 1.5, 1.0)]), F.col("behavior"))
    out = energy.update_energy(t, F.col("temp"), act, dom.salinity_cost(F.coalesce("salinity", F.lit(10.0))))
    t0 = time.perf_counter()
    n = out.agg(F.count(F.lit(1)), F.sum("new_ed"), F.sum("behavior")).first()[0]
    secs = time.perf_counter() - t0
    return secs, n, n / (secs * 1000)


def step_events(spark):
    """Seconds and agents per millisecond of one step of an event list over copied agents.

    A random move, barriers on the way, predation in shared cells, and accumulator updates of who is left.
    """
    from pyspark.sql import functions as F

    from driftgrid.catalog import joins as queries
    from driftgrid.operators import accumulators as acc
    from driftgrid.operators import encounters as enc
    from driftgrid.operators import neighbours as nb
    from driftgrid.plans import star

    a = star.agents(spark, SF_DIR).select("agent_id", "cell").repartition(4 * int(CPUS))
    a = a.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).select((F.col("agent_id") * (COPIES + 1) + F.col("copy")).alias("agent_id"), "cell")
    n = a.count()
    t0 = time.perf_counter()
    moves = nb.random_neighbour(a, queries.adj(spark, SF_DIR), 1)
    there = (nb.barrier_outcome(moves, queries.edge_probs(spark, SF_DIR), 1).filter("outcome <> 'died'")
             .select("agent_id", F.col("final_cell").alias("cell"), F.lit(True).alias("alive"), F.lit(0.0).alias("energy"), F.lit(0.0).alias("age"), F.lit(0.0).alias("clock")))
    predators, prey = there.filter("agent_id % 10 = 0"), there.filter("agent_id % 10 <> 0")
    killed = enc.kills(predators, prey, 0.05, 1)
    left = enc.gains(predators, killed, "energy", 1.0).unionByName(enc.survivors(prey, killed))
    out = acc.apply_updaters(left, [{"function": "Increment", "accumulator": "age", "parameters": [1.0]}, {"function": "TimeStep", "accumulator": "clock", "parameters": [24]},
                                    {"function": "Expression", "accumulator": "energy", "parameters": ["energy * 0.9 + age"]}], t=7)
    out.agg(F.count(F.lit(1)), F.sum("energy"), F.sum("clock")).first()
    secs = time.perf_counter() - t0
    return secs, n, n / (secs * 1000)


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from driftgrid.catalog import QUERIES
    names = sys.argv[1:] or HEADLINE
    QUERIES["agg3_demographics"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
    extra = {}
    if not sys.argv[1:]:
        secs, n, rate = step_update(spark)
        extra = {"step_update": {"sec": round(secs, 3), "agent_steps": n, "agent_steps_per_ms": round(rate, 1)}}
        secs, n, rate = step_events(spark)
        extra["step_events"] = {"sec": round(secs, 3), "agents": n, "agents_per_ms": round(rate, 1)}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": Path(SF_DIR).name.removeprefix("sf"), **extra}))
    spark.stop()


main()
