"""Reachability and components: few rounds on deep graphs, hot keys, cycles, and the joins they rest on."""

import random

import pytest
from pyspark.sql import functions as F

from driftgrid.operators import graph as g
from driftgrid.plans import skew


def closure(edges, seeds):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    rows = set()
    for s in seeds:
        todo, seen = list(out.get(s, ())), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        rows |= {(s, x) for x in seen}
    return rows


@pytest.mark.parametrize("kind", ["tree", "confluences", "cycle", "random"])
def test_reachable_equals_search(spark, kind):
    rnd = random.Random(kind)
    n = 60
    edges = {"tree": [(i, (i - 1) // 3) for i in range(1, n)], "confluences": [(i, i + d) for i in range(n - 3) for d in (1, 3)],
             "cycle": [(i, (i + 1) % 7) for i in range(7)] + [(20, 3), (5, 30), (40, 40)], "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(70)]}[kind]
    seeds = rnd.sample(range(n), 25) + [0, 5, 20, 40]
    e, s = spark.createDataFrame(edges + edges[:3], "src long, dst long"), spark.createDataFrame([(x,) for x in seeds + seeds[:2]], "seed long")
    got = g.reachable(e, s).collect()
    assert {tuple(r) for r in got} == closure(edges, seeds) and len(got) == len(closure(edges, seeds))
    up = {tuple(r) for r in g.reachable(e, s, "upstream").collect()}
    assert up == closure([(b, a) for a, b in edges], seeds)
    assert g.reachable(e.limit(0), s).count() == 0 and g.reachable(e, s.limit(0)).count() == 0


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], g.cut
    monkeypatch.setattr(g, "cut", lambda df: rounds.append(1) or cut(df))
    n = 300
    chain = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    assert g.reachable(chain, spark.createDataFrame([(n - 1,), (5,)], "seed long")).count() == n - 1 + 5
    assert len(rounds) <= 3 * 10


def test_components_of_stars_and_islands(spark):
    rnd = random.Random(2)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1300) for i in range(300)] + [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)] + [(5000, 5000)]
    nodes = sorted({x for e in edges for x in e} | {9999})
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["cell_id"]: r["component"] for r in g.components(spark.createDataFrame([(x,) for x in nodes], "cell_id long"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in nodes}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_equals_join(spark, how, monkeypatch):
    monkeypatch.setattr(skew, "SPAN_ROWS", 10)
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).otherwise(F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    split = skew.split_join(left, right, "k", how)
    key = lambda df: sorted(repr(tuple(r)) for r in df.select("k", "v", "w").collect())
    assert key(split) == key(left.join(right, "k", how))
