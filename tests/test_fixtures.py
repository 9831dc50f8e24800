"""Hand values of the fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from driftgrid.functions import domain as dom
from driftgrid.functions import num
from driftgrid.functions.rand import hash_u, poisson, poisson_cdf
from driftgrid.operators import accumulators as acc
from driftgrid.operators import checks, filters, graph, lookups, reports
from driftgrid.operators import traits as trt


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_hash_u_value(spark):
    assert one(spark, hash_u(42, "1", F.lit(0)).alias("u"))["u"] == 0.38433072925545275


def test_poisson_mean(spark):
    assert poisson_cdf(4.0)[-1] == pytest.approx(1.0)
    m = spark.range(20000).select(F.avg(poisson(hash_u(1, "p", "id"), 4.0)).alias("m")).first()["m"]
    assert m == pytest.approx(4.0, abs=0.06)


def test_numeric_guards(spark):
    nan, inf = F.lit(float("nan")), float("inf")
    r = one(spark, num.gt(nan, 0.0).alias("a"), num.minimum(nan, 1.0).alias("b"), num.divide(F.lit(-1.0), F.lit(0.0)).alias("c"),
            num.log(F.lit(-1.0)).alias("d"), num.mod(F.lit(-7.0), F.lit(3.0)).alias("e"), num.mod(F.lit(7.0), F.lit(-3.0)).alias("f"),
            num.cond(nan, 1.0, 2.0).alias("g"), num.log10(F.lit(0.0)).alias("h"))
    assert r["a"] is False and math.isnan(r["b"]) and r["c"] == -inf and math.isnan(r["d"])
    assert (r["e"], r["f"], r["g"], r["h"]) == (2.0, -2.0, 2.0, -inf)


def test_bounds_rule():
    assert num.bounds_of(0, 0) == (None, None)
    assert num.bounds_of(0, 5) == (0, 5)
    assert num.bounds_of(None, None) == (None, None)


def test_demographics(spark):
    df = spark.createDataFrame([(0, a, m, e) for a, m, e in zip([True, True, False, True, False], [100., 200., 0., 300., 0.], [6., 7., 0., 8., 0.])],
                               "time int, alive boolean, mass_g double, ed_kJ_g double")
    r = reports.demographics(df).first()
    assert (r["n_alive"], r["n_dead"], r["n_total"], r["mean_mass"], r["mean_ed"]) == (3, 2, 5, 200.0, 7.0)


def test_productivity(spark):
    df = spark.createDataFrame([("r", 0, 100), ("r", 1, 110), ("r", 2, 0), ("r", 3, 5)], "run string, t int, n long")
    got = {r["t"]: r["lambda"] for r in reports.productivity(df, ["run"], "t", "n").collect()}
    assert got == {0: 1.0, 1: 1.1, 2: 0.0, 3: 0.0}


def tracks(spark, steps):
    rows = [(t, i, c, True) for t, cs in enumerate(steps) for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "time int, agent_id long, cell long, alive boolean")


def cells(spark, n):
    return spark.range(n).withColumnRenamed("id", "cell_id")


def test_tallies(spark):
    c = cells(spark, 5)
    occ = {r["cell_id"]: r["steps"] for r in reports.occupancy(tracks(spark, [[0, 0, 2, 3]] * 2), c).collect()}
    assert occ == {0: 2, 1: 0, 2: 2, 3: 2, 4: 0}
    den = {r["cell_id"]: r["n"] for r in reports.density(tracks(spark, [[0, 0, 1]] * 2), c).collect()}
    assert den[0] == 4 and den[1] == 2
    flux = {r["cell_id"]: r["net"] for r in reports.flux(tracks(spark, [[0, 0, 1], [1, 0, 2]]), c).collect()}
    assert (flux[0], flux[1], flux[2]) == (-1, 0, 1)


def test_genetics_report(spark):
    g = spark.createDataFrame([(i, "A", 0, 1) for i in range(4)], "agent_id long, locus string, a0 int, a1 int")
    r = reports.genetic_report(g, "A", 3).first()
    assert (r["heterozygosity"], r["freq_allele_0"], r["freq_allele_1"], r["freq_allele_2"]) == (1.0, 0.5, 0.5, 0.0)
    assert reports.genetic_report(g, "missing", 3).count() == 0


def test_energy_density(spark):
    for w, e in ((7900.0, 11761.3), (5092.0, 10281.484), (3000.0, 8721.0)):
        assert one(spark, dom.energy_density(F.lit(w)).alias("e"))["e"] == pytest.approx(e)


def test_hourly_respiration_matches_reference_formula(spark):
    w, t = 3000.0, 15.0
    want = 0.00264 * w ** -0.217 * math.exp(0.06818 * t) * 1.2 * 13560 * w / 24
    assert one(spark, dom.hourly_respiration(F.lit(w), F.lit(t), F.lit(1.2)).alias("e"))["e"] == pytest.approx(want)


def test_energy_is_conserved(spark):
    r = one(spark, dom.update_energy(F.lit(6.5), F.lit(3500.0), F.lit(18.0), F.lit(1.5), F.lit(1.1)).alias("s"))["s"]
    lost = 0.00264 * 3500 ** -0.217 * math.exp(0.06818 * 18) * 1.5 * 13560 * 3500 / 24 * 1.1
    assert r["ed"] * 1000 * r["mass"] == pytest.approx(6.5e3 * 3500 - lost)
    assert r["mass"] == pytest.approx(3500 - lost / 36000) and not r["dead"]


def test_salinity_and_oxygen(spark):
    r = one(spark, dom.salinity_cost(F.lit(10.0)).alias("a"), dom.salinity_cost(F.lit(float("nan"))).alias("b"), dom.salinity_cost(F.lit(99.0)).alias("c"),
            dom.oxygen_state(F.lit(float("nan")), 3.0, 5.5).alias("d"), dom.oxygen_state(F.lit(2.0), 3.0, 5.5).alias("e"))
    assert (r["a"], r["b"], r["d"], r["e"]) == (1.0, 1.0, 0, 2) and r["c"] == pytest.approx(1.3)
    with pytest.raises(ValueError):
        dom.oxygen_state(F.lit(1.0), 6.0, 5.0)


def test_transfer_conserves(spark):
    df = spark.range(50).select(F.col("id").alias("agent_id"), (F.col("id") * 1.5 - 10).alias("a"), F.lit(3.0).alias("b"))
    out = acc.transfer(df, "a", "b", 0.7, src_bounds=(0.0, None))
    before, after = (d.agg(F.sum(F.col("a") + F.col("b"))).first()[0] for d in (df, out))
    assert after == pytest.approx(before)
    with pytest.raises(ValueError):
        acc.transfer(df, "a", "a")


def test_bin_trait_nan_and_edges(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 2.0), (2, 5.0), (3, float("nan"))], "i int, v double")
    got = [r["c"] for r in df.orderBy("i").select(trt.bin_trait("v", [2, 5]).alias("c")).collect()]
    assert got == [0, 1, 2, 2]


def test_filters_errors_and_fallback(spark):
    df = spark.createDataFrame([(0, 1), (1, 0)], "agent_id long, s int")
    with pytest.raises(KeyError):
        filters.filter_by_traits(df, {"s": ["a", "b"]}, other="a")
    with pytest.raises(ValueError):
        filters.trigger_periodic("t", 0)
    assert filters.filter_by_combo(df, ["s"], [2], [0, 1, 1]).count() == 2       # wrong length keeps all
    assert filters.filter_by_combo(df, ["s"], [2], [0, 1]).count() == 1


def test_network_y_shape(spark):
    e = spark.createDataFrame([(1, 3), (2, 3)], "src long, dst long")
    s = spark.createDataFrame([(1, 100.0), (2, 150.0), (3, 200.0)], "segment_id long, length double")
    up = graph.reachable(e, spark.createDataFrame([(3,)], "seed long"), "upstream")
    assert {r["node"] for r in up.collect()} == {1, 2}
    assert {r["segment_id"] for r in graph.headwaters(s, e).collect()} == {1, 2}
    assert {r["segment_id"] for r in graph.outlets(s, e).collect()} == {3}
    loop = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert {r["node"] for r in graph.reachable(loop, spark.createDataFrame([(1,)], "seed long")).collect()} == {1, 2, 3}
    pos = spark.createDataFrame([(7, 3, 50.0, 80.0), (8, 1, 30.0, 10.0), (9, 1, 5.0, 10.0)], "agent_id long, segment_id long, offset double, step double")
    got = {r["agent_id"]: (r["segment_id"], r["offset"]) for r in graph.move_along_network(pos, s, e, "step", 1).collect()}
    assert got[8] == (1, 20.0) and got[9] == (1, 0.0) and got[7][0] in (1, 2) and got[7][1] in (70.0, 120.0)
    down = {r["agent_id"]: (r["segment_id"], r["offset"]) for r in graph.move_along_network(pos.withColumn("step", F.lit(180.0)), s, e, "step", 1, "downstream").collect()}
    assert down == {7: (3, 200.0), 8: (3, 110.0), 9: (3, 85.0)}


def test_align_or_fail(spark):
    f = spark.createDataFrame([(0, 1.0), (1, 2.0)], "cell_id long, v double")
    assert lookups.align_or_fail(cells(spark, 2), f).count() == 2
    with pytest.raises(ValueError, match="first missing id: 2"):
        lookups.align_or_fail(cells(spark, 4), f)


def test_off_mesh_does_not_wrap(spark):
    a = spark.createDataFrame([(1, -1), (2, 1)], "agent_id long, cell long")
    f = spark.createDataFrame([(0, 1.0), (1, 2.0)], "cell_id long, v double")
    assert {r["agent_id"]: r["v"] for r in lookups.sample_field(a, f, ["v"]).collect()} == {1: None, 2: 2.0}


def test_raise_on(spark):
    checks.raise_on(spark.range(0), "none")
    with pytest.raises(ValueError, match="3 violation"):
        checks.raise_on(spark.range(3), "some")


def test_poisson_means_without_a_cap(spark):
    for mean in (0, 4, 500, 800, 100_000):
        m = spark.range(4000).withColumn("u", hash_u(1, "p", "id")).select(F.avg(poisson(F.col("u"), mean)).alias("m")).first()["m"]
        assert m == pytest.approx(mean, rel=0.03, abs=1e-9)
