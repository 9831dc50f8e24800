"""Span scans equal plain windows whatever the span, also for a key with a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftgrid.plans.ordered import previous, ranked, ranked_by_value, running
from driftgrid.plans.quantile import quantiles
from driftgrid.plans.spans import with_spans


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = [(1 if i % 3 == 0 else rnd.randrange(2, 40), i * 3 + rnd.randrange(3), rnd.choice([None, rnd.uniform(-5, 5)]), rnd.randrange(6)) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, t long, v double, c long").cache()


@pytest.mark.parametrize("span", [1, 7, 100, 10 ** 9])
def test_running_equals_window(skewed, rows, span):
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    got = running(skewed, ["k"], "t", {"s": ("sum", F.col("c")), "n": ("count", F.lit(1)), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")),
                                       "la": ("last", F.col("v")), "fi": ("first", F.col("v"))}, span=span)
    want = skewed.select("*", F.sum("c").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"),
                         F.last("v", True).over(w).alias("la"), F.first("v", True).over(w).alias("fi"))
    cols = ["k", "t", "s", "n", "hi", "lo", "la", "fi"]
    assert sorted(map(repr, rows(got, *cols))) == sorted(map(repr, rows(want, *cols)))


@pytest.fixture(scope="module")
def sparse(spark):
    """Ids over 63 bits, half of them in one crowded stretch; a key that holds a third of the rows, and as many with a null key."""
    rnd = random.Random(11)
    ids = rnd.sample(range(1 << 62, (1 << 62) + 4000), 2000) + [rnd.randrange(-(1 << 63), (1 << 63) - 1) for _ in range(2000)]
    rows = [(None if i % 3 == 0 else 1 if i % 3 == 1 else rnd.randrange(2, 300), t, rnd.random(), i % 7) for i, t in enumerate(ids)]
    return spark.createDataFrame(rows, "k long, t long, v double, c long").repartition(6).cache()


def test_spans_follow_the_rows(sparse):
    whole = with_spans(sparse, [], "t", span_rows=100)
    sizes = [r["count"] for r in whole.groupBy("__span").count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert whole.groupBy("__span").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("__span").toPandas().pipe(lambda p: (p["a"][1:].to_numpy() > p["b"][:-1].to_numpy()).all())
    keyed = with_spans(sparse, ["k"], "t", span_rows=100, most=16)
    sizes = keyed.groupBy("k", "__span").count().toPandas()
    assert sizes[sizes["k"].isna()]["count"].max() <= 2 * 1334 / 16 and sizes[sizes["k"] == 1]["count"].max() <= 2 * 1334 / 16
    assert with_spans(sparse, [], "t") is None and with_spans(sparse, ["k"], "t") is None


@pytest.mark.parametrize("depth", [{"span_rows": 100}, {"span_rows": 7, "most": 64}, {}])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_over_sparse_ids_equals_window(sparse, rows, keys, depth):
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    got = running(sparse, keys, "t", {"s": ("sum", F.col("c")), "n": ("count", F.lit(1)), "hi": ("max", F.col("v"))}, span=None, **depth)
    got = running(got, keys, "t", {"p": ("row", F.col("c"))}, before=True, span=None, **depth)
    want = sparse.select("*", F.sum("c").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"), F.max("v").over(w).alias("hi"), F.last("c").over(before).alias("p"))
    assert sorted(map(repr, rows(got, "t", "s", "n", "hi", "p"))) == sorted(map(repr, rows(want, "t", "s", "n", "hi", "p")))


def test_rank_of_crowded_values(sparse, rows):
    crowded = sparse.withColumn("v", F.when(F.col("c") < 3, F.col("v") * 1e-12).when(F.col("c") < 5, F.lit(0.5)).otherwise(F.col("v") * 1e12))
    for keys in ([], ["k"]):
        got = ranked_by_value(crowded.filter("k is not null"), keys, "v", "t", "r", span_rows=50, most=32)
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("v", "t")
        want = crowded.filter("k is not null").select("*", F.row_number().over(w).cast("long").alias("r"))
        assert rows(got, "t", "r") == rows(want, "t", "r")


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_of_values_between_zero_and_one(sparse, accuracy):
    wanted = {"low": 0.0, "a": 0.37, "mid": 0.5, "top": 1.0}
    frames = [sparse, sparse.withColumn("v", F.round("v", 1)), sparse.withColumn("v", F.when(F.col("c") == 0, float("nan")).otherwise(F.exp(F.col("v") * 600)))]
    for f in frames:
        v = f.filter("not isnan(v)")
        for keys in ([], ["k"]):
            got = quantiles(f, keys, "v", wanted, also={"n": F.count(F.lit(1))}, accuracy=accuracy).toPandas()
            want = v.groupBy(*keys).agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in wanted.items()], F.count(F.lit(1)).alias("n")).toPandas()
            key = keys + ["n"]
            a, b = got.sort_values(key)[[*key, *wanted]].to_numpy(), want.sort_values(key)[[*key, *wanted]].to_numpy()
            assert a.shape == b.shape and all(pytest.approx(y, rel=1e-9, nan_ok=True) == x for x, y in zip(a.astype(float).ravel(), b.astype(float).ravel()))


@pytest.mark.parametrize("span", [1, 64, 10 ** 9])
def test_previous_is_lag(skewed, rows, span):
    w = Window.partitionBy("k").orderBy("t")
    got = previous(skewed, ["k"], "t", {"p": "v", "pc": "c"}, span=span)
    want = skewed.select("*", F.lag("v").over(w).alias("p"), F.lag("c").over(w).alias("pc"))
    assert sorted(map(repr, rows(got, "k", "t", "p", "pc"))) == sorted(map(repr, rows(want, "k", "t", "p", "pc")))


def test_ranked_global_and_by_value(skewed, rows):
    got = ranked(skewed, [], "t", "r", span_rows=50)
    want = skewed.select("*", F.row_number().over(Window.orderBy("t")).cast("long").alias("r"))
    assert rows(got, "t", "r") == rows(want, "t", "r")
    solid = skewed.withColumn("v", F.col("c").cast("double"))       # heavy ties
    got = ranked_by_value(solid, ["k"], "v", "t", "r", descending=True, span_rows=2, most=16)
    want = solid.select("*", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "t")).cast("long").alias("r"))
    assert rows(got, "k", "t", "r") == rows(want, "k", "t", "r")


def test_quantiles_are_exact(skewed):
    v = skewed.filter("v is not null")
    got = {r["k"]: (r["a"], r["b"]) for r in quantiles(v, ["k"], "v", {"a": 0.5, "b": 0.9}, accuracy=40).collect()}
    want = {r["k"]: (r["a"], r["b"]) for r in v.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.9)).alias("b")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_results_do_not_depend_on_partitioning(spark, sf, rows):
    from driftgrid.catalog import QUERIES
    for name in ("gen3_introduce", "join5_kills", "acc22_assign_random_n", "gen2_pick_mate"):
        a = rows(QUERIES[name](spark, sf))
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = rows(QUERIES[name](spark, sf))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert a == b
