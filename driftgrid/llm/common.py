"""Helpers of the operators here: written intermediate tables, hold-outs, bounded samples, splitters."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.plans.lineage import work_path

KEY_BITS = 63


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PATHS: WeakKeyDictionary = WeakKeyDictionary()     # where stored() wrote a frame
_SCOPES: list[list[str]] = []


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df written to the shared folder and read back: lost executors cost no recomputation, and row ids freeze.

    options: of the parquet writer.
    """
    path = work_path(df.sparkSession, label)
    for scope in _SCOPES:
        scope.append(path)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


@contextmanager
def written_tables() -> Iterator[list[str]]:
    """The paths of all tables that stored() writes inside the block; whoever writes the block's result can delete them then."""
    _SCOPES.append(paths := [])
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders through the file system that holds them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of frames from stored() that nothing reads any more."""
    for frame in frames:
        delete(frame.sparkSession, [_PATHS[frame]])


def lean_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From here on this session hands Python at most `rows` rows at once.

    Ten thousand documents, the default, take hundreds of MB in each worker and in Arrow's buffers. Results do not
    depend on it; a smaller value that the session has already is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def lean_reads(spark: SparkSession, rows: int = 512) -> None:
    """From here on this session reads parquet files in small pieces of memory, and decodes at most `rows` rows at once.

    The reader keeps the texts of a batch in one array a task, and a column of a row group in one buffer: with the defaults tens
    of MB in one piece, for which a heap shared by many tasks finds no room. Results do not depend on it; a smaller batch
    that the session has already is kept.
    """
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    spark.conf.set("parquet.read.allocation.size", 1 << 18)      # below half a region of G1, so buffers need no regions of their own


def drop_finished_shuffles(spark: SparkSession) -> None:
    """From here on this session deletes a query's shuffle files when the query ends, not when the driver collects garbage.

    A frame that is executed again writes its shuffles again.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def bounded(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most `most` rows with the smallest values of `order` (a hash).

    The rows are first cut by a hash threshold on the map side, so only about `most` of them travel.
    """
    n = rows.count()
    if n > most:
        cut = -(1 << 63) + int((1 << 64) * min(1.0, (most + 4 * most ** 0.5) / n))
        rows = rows.filter(F.col(order) < F.lit(min(cut, (1 << 63) - 1)))
    return rows.orderBy(order).limit(most)


def trim() -> None:
    """Hands back to the system what earlier work of this Python worker has freed; a worker serves many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)         # glibc only
    if give_back is not None:
        give_back(0)


def chunks(frames: Iterator[pd.DataFrame], column: str, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Arrow batches cut further so that the texts of a chunk hold about `chars` characters (a long text stays whole)."""
    trim()
    for frame in frames:
        if not len(frame):
            continue
        total = frame[column].str.len().fillna(0).astype("int64").cumsum().to_numpy()
        part = total // chars
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(frame)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield frame.iloc[a:b]


def below(keys: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Weight of all keys under each probe, counted exactly: one row per task and bin is exchanged."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(probes) + 1, dtype=np.int64)
        for f in frames:
            at = np.searchsorted(probes, f["key"].to_numpy(), side="right")
            np.add.at(total, at, f["weight"].to_numpy())
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"bin": hit.astype(np.int64), "weight": total[hit]})

    out = np.zeros(len(probes) + 1, dtype=np.int64)
    for bin_, w in keys.select("key", "weight").mapInPandas(count, "bin long, weight long").groupBy("bin").agg(F.sum("weight")).collect():
        out[bin_] = w
    return np.cumsum(out)[:-1]


def splitters(keys: DataFrame, targets: list[int], tolerance: list[int]) -> np.ndarray:
    """Histogram-sort splitters: for each target the key whose weight below comes within tolerance of it.

    keys: (key long from 0 to 2^63 - 1, weight long). Each round places probes evenly in the interval of
    every open splitter, counts the exact weight below them and narrows the interval; a splitter is
    done within tolerance, or when no key lies between its two bounds.
    """
    n = len(targets)
    lo, hi = np.zeros(n, dtype=np.int64), np.full(n, (1 << KEY_BITS) - 1, dtype=np.int64)
    want, tol = np.asarray(targets, dtype=np.int64), np.asarray(tolerance, dtype=np.int64)
    under = np.zeros(n, dtype=np.int64)              # weight below lo
    best, error = lo.copy(), want.copy()             # key 0 has nothing below it
    open_ = error > tol
    while open_.any():
        at = np.flatnonzero(open_)
        per = max(8, min(512, (1 << 18) // len(at)))
        step = np.maximum(1, (hi[at] - lo[at]) // (per + 1))
        grid = lo[at][:, None] + step[:, None] * np.arange(1, per + 1)
        grid = np.minimum(grid, hi[at][:, None])
        probes = np.unique(grid)
        w = below(keys, probes)
        j = np.searchsorted(w, want[at], side="right")          # probes[j - 1] is the last at or under the target
        for k, i in zip(j, at, strict=True):
            for p in (k - 1, k):
                if 0 <= p < len(probes) and abs(int(w[p]) - int(want[i])) < error[i]:
                    best[i], error[i] = probes[p], abs(int(w[p]) - int(want[i]))
            if k > 0 and probes[k - 1] > lo[i]:
                lo[i], under[i] = probes[k - 1], w[k - 1]
            if k < len(probes):
                hi[i] = min(hi[i], probes[k])
        open_ = (error > tol) & (hi - lo > 1)
    return np.maximum.accumulate(best)
