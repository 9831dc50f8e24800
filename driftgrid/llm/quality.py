"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import below, stored
from driftgrid.llm.features import MIX, word_hashes

BUCKETS = 10_000


def bag(text: str) -> np.ndarray:
    """Bucket of every word and every pair of adjacent words."""
    h = word_hashes(text)
    pairs = (h[:-1] * MIX) ^ h[1:]
    return ((np.concatenate([h, pairs * MIX]) >> np.uint64(16)) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts: one row per task and bucket is exchanged."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for f in frames:
            for t in f["text"]:
                if isinstance(t, str):
                    total += np.bincount(bag(t), minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": hit, "n": total[hit]})

    out = np.zeros(BUCKETS)
    for b, n in texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gumbel(key: Column) -> Column:
    """Standard Gumbel draw from a hash of the key: the same for any partitioning or retry."""
    u = (F.pmod(F.xxhash64(key.cast("string"), F.lit("gumbel")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def fit_weights(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality") -> tuple[np.ndarray, float]:
    """Log ratio of target over raw probability per bucket, and the share of target rows among labels.

    The raw model counts every document, the target model every document labelled good (an id with
    contradicting labels is not good). Both are smoothed by one occurrence per bucket; without good rows the ratio is that of
    an even model.
    """
    known = labels.select(F.col(key).alias("key"), F.col(good).cast("int").alias("good")).filter(F.col("key").isNotNull() & F.col("good").isin(0, 1))
    known = known.groupBy("key").agg(F.min("good").alias("good"))
    n, target = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("good"), F.lit(0))).first()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    raw = bucket_counts(rows.select("text")) + 1
    wanted = bucket_counts(rows.join(known.filter("good = 1").hint("merge"), "key", "left_semi").select("text")) + 1
    return np.log(wanted / wanted.sum()) - np.log(raw / raw.sum()), (target / n if n else 1.0)


def cut_key(ranks: DataFrame, k: int) -> int:
    """The smallest rank that, with all ranks below it, covers k rows: so a group of ties at the cut stays whole.

    ranks: (key long, weight long). A bracket is narrowed by exact counts below evenly spaced probes.
    """
    low, high = -(1 << 63), (1 << 63) - 1                # fewer than k rows lie below low, k or more up to high
    while high - low > 0:
        step = max(1, (high - low) // 512)
        probes = np.unique(np.minimum(low + step * np.arange(1, 513, dtype=object), high).astype(np.int64))
        under = below(ranks, probes)                     # rows with a rank smaller than the probe
        enough = int(np.searchsorted(under, k))          # first probe with k rows below it
        if enough < len(probes):
            high = int(probes[enough]) - 1
        if enough:
            low = int(probes[enough - 1])
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, key: str = "doc_id", text: str = "text",
             good: str = "quality", temperature: float = 1.0) -> DataFrame:
    """key, log_weight, gumbel_key, kept for every row; kept marks the Gumbel top-k by log_weight + noise.

    log_weight is the log of the importance weight, the sum of the log ratios of all n-grams, over `temperature` (1: the
    weight itself). Long texts thus have weights far from 0, and noise decides among near ones. A text without words
    (null, empty) has log_weight 0. k is `share` of all rows, by default the share of good rows among labels. The k-th key is
    found by exact counts below probes, never by a sort in one task. Rows that tie with it (repeats of a row) all stay. Rows with
    a null id share one draw. Very long texts are weighed whole. An empty table gives no rows; extra columns are not read.
    """
    ratio, prior = fit_weights(docs, labels, key, text, good)
    share = prior if share is None else share

    @F.pandas_udf("double")
    def weight(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = np.zeros(len(s))
            for i, t in enumerate(s):
                codes = bag(t) if isinstance(t, str) else ()
                if len(codes):
                    out[i] = ratio[codes].sum() / temperature
            yield pd.Series(out)

    @F.pandas_udf("long")
    def rank(keys: pd.Series) -> pd.Series:
        """A long for every double, in descending order: the bits of a positive double grow with it, those of a negative one fall."""
        bits = (0.0 - keys.to_numpy(dtype=float)).view(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))

    drawn = docs.select(F.col(key).alias("key"), weight(text).alias("log_weight")).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("key")))
    drawn = stored(drawn.withColumn("rank", rank("gumbel_key")), "quality-keys")
    k = round(drawn.count() * share)
    kept = F.col("rank") <= cut_key(drawn.select(F.col("rank").alias("key"), F.lit(1).cast("long").alias("weight")), k) if k > 0 else F.lit(False)
    return drawn.select(F.col("key").alias(key), "log_weight", "gumbel_key", kept.alias("kept"))
