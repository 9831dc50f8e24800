"""Position streams and how they are run."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid import schemas
from driftgrid.plans.lineage import work_path
from driftgrid.plans.star import as_positions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END_OF_TIME = "2100-01-01 00:00:00"
MARKER = -1        # agent id of the row that ends a replay


def event_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events files as a stream with the fixed schema."""
    return spark.readStream.schema(schemas.EVENTS).options(**options).parquet(path)


def hourly_steps(positions: DataFrame, width: str = "1 hour") -> DataFrame:
    """The last position of each individual per step, once the step is closed.

    This is the one-row-per-step form that the keyed state works on. It is an ordinary windowed
    aggregate with partial aggregation, so an individual that sends a large share of all events
    reaches its keyed state with at most one row per step.
    """
    rest = [c for c in positions.columns if c not in ("agent_id", "ts")]
    last = positions.groupBy(F.window("ts", width), "agent_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("s"))
    return last.select("agent_id", F.window_time("window").alias("ts"), "s.*")


def _marker_rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(-1).cast("long").alias("event_id"), F.lit(END_OF_TIME).cast("timestamp_ntz").alias("ts"),
                                 F.lit(MARKER).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))


def marker_folder(spark: SparkSession) -> str:
    """An empty folder of events that `end_replay` fills once all real files are read."""
    path = work_path(spark, "marker")
    _marker_rows(spark, 0).write.parquet(path)
    return path


def end_replay(spark: SparkSession, marker: str) -> None:
    """One far-future row. A replay of a finished table needs it, and after the last real batch: without later
    rows the watermark would never pass the last real ones, and any earlier it would make them late."""
    _marker_rows(spark, 1).write.mode("append").parquet(marker)


def positions(spark: SparkSession, path: str, delay: str = "10 minutes", marker: str | None = None, **options) -> DataFrame:
    """The position stream with its watermark; a replay also reads the marker folder (see run_to_table)."""
    s = event_stream(spark, path, **options)
    if marker:
        s = s.unionByName(event_stream(spark, marker))
    return as_positions(s).withWatermark("ts", delay)


@contextmanager
def rocksdb(spark: SparkSession):
    """Keyed state with timers and lists needs the RocksDB store; the old setting comes back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _drain(query) -> int:
    """Wait for a query's end; rows it dropped as late, over all batches.

    A query keeps its last 100 reports only, so they are read every second while it runs.
    """
    seen, done = {}, False
    while not done:
        done = query.awaitTermination(1)
        for p in query.recentProgress:
            seen[p.batchId, p.timestamp] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
    return sum(seen.values())


def run_to_table(stream: DataFrame, label: str, finished: list | None = None, marker: str | None = None) -> DataFrame:
    """Drain what is available into a parquet table in the shared folder and return it.

    With a marker folder the marker is delivered after the last real batch and the query goes on from its
    checkpoint, so results behind the watermark come out whatever the number of batches. The rows dropped as
    late are added to the list `finished`, one count per run.
    """
    spark = stream.sparkSession
    out, ckpt = work_path(spark, label), work_path(spark, label + "-state")
    for last in (False, True) if marker else (False,):
        if last:
            end_replay(spark, marker)
        with rocksdb(spark):
            dropped = _drain(stream.writeStream.outputMode("append").trigger(availableNow=True).format("parquet")
                             .option("path", out).option("checkpointLocation", ckpt).start())
        if finished is not None:
            finished.append(dropped)
    return spark.read.schema(stream.schema).parquet(out)


def replay(spark: SparkSession, parts, build, label: str, finished: list | None = None) -> DataFrame:
    """The table that build makes of the position stream when the event frames `parts` arrive one after the other.

    The normal tasks write each part, and one run from the same checkpoint reads all its files as one batch. Until
    the marker has arrived no empty batch follows a part, so the watermark moves from part to part only.
    """
    path, out, ckpt = work_path(spark, "arrivals"), work_path(spark, label), work_path(spark, label + "-state")
    key, stream = "spark.sql.streaming.noDataMicroBatches.enabled", None
    old = spark.conf.get(key)
    for part in (*parts, None):
        if part is None:
            end_replay(spark, path)
        else:
            part.write.mode("append").parquet(path)
        stream = stream if stream is not None else build(positions(spark, path))
        spark.conf.set(key, old if part is None else "false")
        try:
            with rocksdb(spark):
                dropped = _drain(stream.writeStream.outputMode("append").trigger(availableNow=True).format("parquet")
                                 .option("path", out).option("checkpointLocation", ckpt).start())
        finally:
            spark.conf.set(key, old)
        if finished is not None:
            finished.append(dropped)
    return spark.read.schema(stream.schema).parquet(out)


def deliver(spark: SparkSession, parts) -> str:
    """Write small event frames one after the other into one folder, as one file each that arrive in this order.

    One task writes a part; `replay` is for whole tables.
    """
    path = work_path(spark, "arrivals")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    end_replay(spark, path)
    return path
