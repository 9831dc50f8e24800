"""The rolling mean of the stream takes every event, also several of one individual in one hour."""

from datetime import datetime, timedelta

import duckdb

from driftgrid.catalog import ORACLES, QUERIES

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
# event, minute since 2024-01-01, individual, value; individual 7 dies after 480 hours, 3 arrives after 600
EVENTS = [(1, 1, 1, 10.0), (2, 30, 1, 40.0), (3, 30, 1, 70.0), (4, 59, 1, 100.0), (5, 61, 1, 130.0), (6, 200, 1, 5.0), (6, 200, 1, 5.0),
          (10, 479 * 60 + 5, 7, 1.0), (11, 479 * 60 + 9, 7, 2.0), (12, 480 * 60 + 1, 7, 90.0), (13, 480 * 60 + 2, 7, 80.0),
          (20, 5, 3, 3.0), (21, 600 * 60 + 7, 3, 50.0)]


def test_every_event_is_a_sample(spark, rows, tmp_path):
    start = datetime(2024, 1, 1)
    frame = spark.createDataFrame([(e, start + timedelta(minutes=m), u, "view", v, "{}") for e, m, u, v in reversed(EVENTS)], SCHEMA)
    frame.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    want, last, mean = [], {}, {}
    for e, m, u, v in EVENTS:
        if not (u % 7 == 0 and m >= 480 * 60) and not (u % 3 == 0 and m >= 600 * 60):
            last[u] = (*last.get(u, (15.0, 15.0, 15.0))[1:], 3000.0 + v)
            mean[u] = sum(last[u]) / 3
        want.append((u, e, round(mean[u], 6)))
    got = rows(QUERIES["str2_rolling_mean"](spark, str(tmp_path)), "agent_id", "event_id", "mean3")
    assert got == sorted(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.execute(ORACLES["str2_rolling_mean"]).fetchall()) == got
