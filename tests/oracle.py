"""Compare a registered query with its SQL twin."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


def both(spark, con, name, sf):
    from driftgrid.catalog import ORACLES, QUERIES
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols
    return got, want
