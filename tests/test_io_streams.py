"""Readers on hand-written files, and streams fed out of order over several batches."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftgrid.operators import steps as st
from driftgrid.plans import star
from driftgrid.sources import readers as rd
from driftgrid.sources import writers as wr
from driftgrid.streaming import state, windows
from driftgrid.plans.lineage import work_path
from driftgrid.streaming.source import MARKER, deliver, hourly_steps, marker_folder, positions, run_to_table


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_tracks_old_and_new(spark, tmp_path):
    old = put(tmp_path / "old.csv", "time,agent_id,tri_idx,lat,lon,ed_kJ_g,behavior,alive,arrived\n0,0,297,55.4,20.9,6.49,3,True,False\n")
    r = rd.read_tracks(spark, old).first()
    assert r["alive"] is True and r["arrived"] is False and r["sea_age"] is None and r["tri_idx"] == 297


def test_census(spark, tmp_path):
    head = 'Run, Time Step, Population Size, Group Members, Floaters, Lambda, "Trait Index  0", "Trait Index  1"\n'
    put(tmp_path / "scenario.0.csv", head + "0,0,100,0,100,1.000000,60,40\n0,1,5,0\n0,1,90,0,90,0.9,50,40\n0,1,95,0,95,0.95,55,40\n")
    put(tmp_path / "notes.csv", "a,b\n1,2\n")
    got = sorted((r["pop_id"], r["step"], r["size"], r["lambda"], r["trait_index"], r["n"]) for r in rd.read_census(spark, str(tmp_path / "*.csv")).collect())
    assert got == [(0, 0, 100, 1.0, 0, 60), (0, 0, 100, 1.0, 1, 40), (0, 1, 95, 0.95, 0, 55), (0, 1, 95, 0.95, 1, 40)]


def test_probe_and_log(spark, tmp_path):
    p = put(tmp_path / "probe.csv", "Run,Time Step,Population,Individual,Acc0,Acc1\n0,3,1,7,2.5,oops\n0,3,1,7,3.5,x\n")
    names = spark.createDataFrame([(1, 0, "mass")], "pop_id int, idx int, acc string")
    got = sorted((r["acc"], r["value"]) for r in rd.read_probe(spark, p, names).collect())
    assert got == [("Acc1", 0.0), ("mass", 3.5)]
    log = put(tmp_path / "run.log", "hello\nCEN, 1, 0, 55, x\nCEN,1\nCEN, 1, 0, 60, x\n")
    assert [tuple(r) for r in rd.read_census_log(spark, log).collect()] == [(1, 0, 60)]


def test_barrier_text(spark, tmp_path):
    p = put(tmp_path / "b.txt", 'C 1 0.1 0.2 "Low dam"\n\nE 5 2 1\nE 6 3 9\n')
    got = sorted((r["hex_id"], r["class_name"]) for r in rd.read_barrier_text(spark, p).collect())
    assert got == [(5, "Low dam"), (6, "")]
    with pytest.raises(ValueError, match="out of range"):
        rd.read_barrier_text(spark, p, n_hexagons=6)


def test_edge_outcomes_errors(spark, tmp_path):
    cells = spark.createDataFrame([(1,), (2,)], "cell_id long")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    ok = put(tmp_path / "ok.csv", "from_h3,to_h3,mortality,deflection,transmission,note\n 1,2,0.1,0.2,0.7,a\n1,2,0.2,0.2,0.6,b\n1,9,0.5,0.5,0.5,c\n")
    assert [tuple(r) for r in rd.read_edge_outcomes(spark, ok, cells, edges).collect()] == [("1", "2", 0.2, 0.2, 0.6)]
    bad = put(tmp_path / "bad.csv", "from_h3,to_h3,mortality,deflection,transmission\n1,2,0.5,0.5,0.5\n")
    with pytest.raises(ValueError, match="sum to 1"):
        rd.read_edge_outcomes(spark, bad, cells)
    far = put(tmp_path / "far.csv", "from_h3,to_h3,mortality,deflection,transmission\n2,1,0.5,0.5,0.0\n")
    with pytest.raises(ValueError, match="not neighbours"):
        rd.read_edge_outcomes(spark, far, cells, edges)
    short = put(tmp_path / "short.csv", "from_h3,to_h3,mortality\n1,2,1.0\n")
    with pytest.raises(ValueError, match="lacks columns"):
        rd.read_edge_outcomes(spark, short, cells)


def test_matrix_layer_and_names(spark, tmp_path):
    plain = put(tmp_path / "a.csv", "1,2\n3,4\n")
    headed = put(tmp_path / "b.csv", '"x","y"\n1,2\n3,4\n')
    want = [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    for p in (plain, headed):
        assert sorted(tuple(r) for r in rd.read_matrix_csv(spark, p).collect()) == want
    assert rd.file_name(r"F:\some\where\table.csv") == "table.csv"
    layer = spark.createDataFrame([(0, 1.5), (1, 0.0), (4, 2.25)], "cell_id long, value double")
    wr.write_layer_csv(layer, str(tmp_path / "layer"))
    assert sorted(tuple(r) for r in rd.read_layer_csv(spark, str(tmp_path / "layer")).collect()) == [(0, 1.5), (4, 2.25)]


def test_matrix_of_many_blocks(spark, tmp_path):
    headed = [[r * 3.0 + c for c in range(3)] for r in range(400)]
    plain = [[-r * 2.0, r / 4] for r in range(150)]
    put(tmp_path / "m" / "headed.csv", "\n  \n" + "x,y,z\r\n" + "".join(",".join(map(str, r)) + ("\n\n" if i % 7 == 0 else "\n") for i, r in enumerate(headed)))
    put(tmp_path / "m" / "plain.csv", "\n".join(",".join(map(str, r)) for r in plain))
    put(tmp_path / "m" / "empty.csv", "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        path = str(tmp_path / "m")
        assert rd.read_lines(spark, path).select("file", "block").distinct().count() > 10
        got = sorted(tuple(r) for r in rd.read_matrix_csv(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((r, c, float(v)) for m in (headed, plain) for r, row in enumerate(m) for c, v in enumerate(row))


def test_snapshot_without_folder_writes_nothing(spark):
    wr.write_snapshot(spark.range(1), None)


def test_grid_index(spark):
    df = spark.createDataFrame([(55.0, 20.0), (54.0, 20.5)], "lat double, lon double")
    assert sorted((r["lat"], r["gi"], r["gj"]) for r in rd.grid_index(df).collect()) == [(54.0, 0, 1), (55.0, 1, 0)]


def test_steps(spark):
    with pytest.raises(KeyError, match="known"):
        st.chain(spark.range(1), ["no such step"])
    df = spark.range(4).withColumn("x", F.lit(1.0))
    assert st.chain(df, [lambda d: d.withColumn("x", F.col("x") + 1)]).agg(F.sum("x")).first()[0] == 8.0
    out = st.repeat(df, [lambda d: d.withColumn("x", F.when(F.col("in_mask"), F.col("x") * 10).otherwise(F.col("x")))] * 2, 2, lambda: F.col("x") < 5)
    assert {r["x"] for r in out.collect()} == {100.0}       # the second member sees the mask of its iteration


def shuffled(spark, sf, n):
    """The events in n deliveries that are out of order by less than the watermark delay allows."""
    e = star.table(spark, sf, "events")
    return [e.filter(F.pmod(F.hash("event_id"), F.lit(n)) == k) for k in range(n)]


def real(df):
    return df.filter(F.col("agent_id") != MARKER)


def test_out_of_order_batches_equal_one_batch(spark, sf, rows):
    path = deliver(spark, shuffled(spark, sf, 3))
    many = positions(spark, path, delay="40 days", maxFilesPerTrigger="1")
    for run in (lambda p: state.rolling_mean(p, "mass_g"), state.moves):
        marker = marker_folder(spark)
        once = positions(spark, f"{sf}/events.parque[t]", marker=marker)
        a, b = rows(real(run_to_table(run(many), "eq"))), rows(real(run_to_table(run(once), "eq", marker=marker)))
        assert a == b and a


def test_sticky_flags_never_fall(spark, sf):
    from driftgrid.catalog import QUERIES
    flags = QUERIES["str4_sticky_flags"](spark, sf).join(star.table(spark, sf, "events").select("event_id", "ts"), "event_id")
    per = {}
    for r in flags.orderBy("agent_id", "ts", "event_id").collect():
        old = per.get(r["agent_id"], (-1, False, False))
        assert not (old[1] and not r["ever_in"]) and not (old[2] and not r["arrived"]) and (old[0] == -1 or old[0] == r["tag"])
        per[r["agent_id"]] = (r["tag"], r["ever_in"], r["arrived"])


def test_late_rows_are_dropped_and_counted(spark, sf):
    e = star.table(spark, sf, "events")
    n = e.count()
    late = F.col("event_id") % 10 == 0
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    path = deliver(spark, [e.filter(~late & (F.col("event_id") < half)), e.filter(~late & (F.col("event_id") >= half)), e.filter(late)])
    queries = []
    out = real(run_to_table(state.rolling_mean(positions(spark, path, maxFilesPerTrigger="1"), "mass_g"), "late", queries))
    kept, dropped = out.count(), sum(queries)
    assert dropped > 0 and kept + dropped == n
    assert out.filter(late).count() == n - dropped - e.filter(~late).count()


def test_late_rows_query_writes_its_parts_by_many_tasks(spark, sf, rows, tmp_path):
    from driftgrid.catalog import ORACLES, QUERIES
    from tests.oracle import connect
    from driftgrid.plans.lineage import shared_dir
    star.table(spark, sf, "events").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    old, key = set(Path(shared_dir(spark)).glob("arrivals-*")), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        got = rows(QUERIES["str8_late_rows"](spark, str(tmp_path)), "hour", "n")
    finally:
        spark.conf.set(key, before)
    made, = set(Path(shared_dir(spark)).glob("arrivals-*")) - old
    assert len(list(made.glob("*.parquet"))) > 4         # three parts and the marker
    want = connect(sf).execute(ORACLES["str8_late_rows"]).fetchall()
    assert got == sorted(want)


def test_hourly_steps_match_the_batch_view(spark, sf, rows):
    marker = marker_folder(spark)
    steps = real(run_to_table(hourly_steps(positions(spark, f"{sf}/events.parque[t]", marker=marker)), "steps", marker=marker))
    e = star.table(spark, sf, "events").withColumn("hour", star.hour_of("ts").cast("int"))
    last = e.groupBy("user_id", "hour").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert rows(steps, "agent_id", "hour", "event_id") == rows(last)


def test_replay_in_many_batches_keeps_every_row(spark, sf):
    e = star.table(spark, sf, "events")
    cut = e.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()[0]
    path, marker = work_path(spark, "arrivals"), marker_folder(spark)
    for lo, hi in zip([None, *cut], [*cut, None], strict=True):
        part = e if lo is None else e.filter(F.col("ts") >= lo)
        (part if hi is None else part.filter(F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(path)
    out = run_to_table(windows.counts(positions(spark, path, marker=marker, maxFilesPerTrigger="1")), "many", marker=marker)
    assert out.agg(F.sum("n")).first()[0] == e.count()
