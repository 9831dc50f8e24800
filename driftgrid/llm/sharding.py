"""Shards of near-equal bytes by histogram sort: count below probes, refine splitters, exchange once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import splitters, stored

PIECE_BYTES = 256 << 20
ROW_BYTES = 16


def order_key(key: str, text: str) -> Column:
    """63-bit sort key: 40 bits of the text's hash, then 23 bits of the id's hash.

    Equal texts stand together, yet a group of copies of any size can be cut between shards.
    """
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(text)), 24), 23)
    return high.bitwiseOR(F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << 23) - 1)))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text",
          tolerance: float = 0.001, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (gapless from 0 in a shard); bytes per shard are near equal.

    A narrow table of (key, size) is written once. Exact byte counts below candidate keys are taken over
    it, round by round, until each splitter is within tolerance of its share (or no key lies nearer). A
    shard above piece_bytes is cut into pieces by further, coarser splitters, so a task never has
    to hold a shard; row counts per piece give each piece its first slot. Then whole rows move once, each
    piece to its own task.

    Size of a row: UTF-8 bytes of the text (null: none) plus 16. Rows that repeat both id and text share a
    key and stay in one shard. A null id sorts like any other value. An empty table gives an empty result.
    Other columns are kept; columns called shard or slot are replaced.
    """
    rows = docs.select(F.struct("*").alias("row"), order_key(key, text).alias("key"), size_of(F.col(text)).alias("weight"))
    keys = stored(rows.select("key", "weight"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    per = max(1, -(-total // (shards * piece_bytes)))
    cuts = [total * i // (shards * per) for i in range(1, shards * per)]
    share = total // max(1, shards * per)
    edges = splitters(keys, cuts, [int(share * (tolerance if i % per == 0 else 0.1)) for i in range(1, shards * per)])

    @F.pandas_udf("int")
    def piece_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), side="right").astype(np.int32))

    counts = {p: n for p, n in keys.groupBy(piece_of("key").alias("piece")).agg(F.count(F.lit(1))).collect()}
    bases, base = [], 0
    for p in range(shards * per):
        base = 0 if p % per == 0 else base
        bases.append((p, p // per, base))
        base += counts.get(p, 0)
    starts = docs.sparkSession.createDataFrame(bases, "piece int, shard int, base long")

    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed = (rows.withColumn("piece", piece_of("key")).repartitionById(shards * per, "piece")
              .sortWithinPartitions("key", F.col("row")[key], "weight")
              .select("row", "piece", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    return (placed.join(F.broadcast(starts), "piece")        # one row per piece: shards, or total bytes / 256 MB
            .select(*[F.col("row")[c].alias(c) for c in names], "shard", (F.col("base") + F.col("place")).alias("slot")))
