"""Exact top-k inner-product search by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.common import stored

QUERY_BLOCK, SEEDS = 8_192, 2_048


def _matrix(blobs: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(blobs), dims), dtype=np.int64)
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, dtype="<i8")
        out[i, :len(v)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def pivot_table(vectors: DataFrame, pivots: int, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Written table (vec_id, q, to_pivots) and the pivots: floor(256 * x) of each component as long bytes, and
    precomputed distances to every pivot. Pivots are the rows with the smallest hash of their key."""
    def quantise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, blobs = [], []
            for i, v in zip(f["vec_id"], f["v"], strict=True):
                x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    blobs.append(np.floor(256 * x).astype("<i8").tobytes())
            yield pd.DataFrame({"vec_id": np.array(ids, dtype=np.int64), "q": blobs})

    found = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter("vec_id is not null and v is not null")
    ints = found.mapInPandas(quantise, "vec_id long, q binary")
    first = stored(ints, "pivot-vectors")
    head = [bytes(r["q"]) for r in first.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(pivots).collect()]
    dims = (first.agg(F.max(F.length("q"))).first()[0] or 0) // 8
    corners = _matrix(pd.Series(head, dtype=object), dims)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d = _distances(_matrix(f["q"], dims), corners)
            yield pd.DataFrame({"vec_id": f["vec_id"], "q": f["q"], "to_pivots": [r.tobytes() for r in d]})

    return stored(first.mapInPandas(measure, "vec_id long, q binary, to_pivots binary"), "pivot-table"), corners


def _floating(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every inner product stays under 2^52 and so is exact, else as they are."""
    small = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[1] < 2.0 ** 52
    return (c.astype(np.float64), q.astype(np.float64)) if small else (c, q)


def _best(q: np.ndarray, own: int, c: np.ndarray, ids: np.ndarray, bound: np.ndarray, floor: float, have: list, k: int) -> list:
    """have, merged with the candidates whose bound can still reach the k-th score, taken by falling bound."""
    at = np.flatnonzero(bound >= (max(floor, have[-1][0]) if len(have) == k else floor))
    at = at[np.argsort(-bound[at], kind="stable")]
    step, i = 64, 0
    while i < len(at) and not (len(have) == k and bound[at[i]] < have[-1][0]):
        part = at[i:i + step]
        s = c[part] @ q
        if len(have) == k:
            part, s = part[s >= have[-1][0]], s[s >= have[-1][0]]
        have = sorted(have + [(int(x), int(j)) for x, j in zip(s, ids[part], strict=True) if j != own], key=lambda x: (-x[0], x[1]))[:k]
        i, step = i + step, step * 2
    return have


def _floors(q: np.ndarray, own: np.ndarray, seeds: list, k: int) -> np.ndarray:
    """For each query its k-th best score among the seed rows, which the true k-th score can't be under."""
    out = np.full(len(q), -np.inf)
    ids = np.array([r["vec_id"] for r in seeds], dtype=np.int64)
    c = _matrix(pd.Series([bytes(r["q"]) for r in seeds], dtype=object), q.shape[1])
    c, q = _floating(c, q)
    for i in range(len(q)):
        s = np.sort((c @ q[i])[ids != own[i]])
        out[i] = s[-k] if len(s) >= k else -np.inf
    return out


def search(vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Queries are the rows whose key is divisible by `every`; candidates all rows but those with the query's own
    key. By the triangle inequality |d(q, p) - d(c, p)| bounds the distance of q and c from below; the
    largest over all pivots bounds the inner product (|q|^2 + |c|^2 - d^2) / 2 from above. Candidates
    are evaluated by falling bound until the bound is under the k-th score (from the start, under the k-th
    among 2,048 seed rows); equal scores go to the smaller
    vec_id, so a bound that equals the k-th score is still evaluated. Scores are exact 64-bit integers.

    Queries go to the tasks in blocks of at most 8,192 rows; a task returns k rows per query. Rows without
    key or vector, or with a null or non-finite component, take no part; a shorter vector counts as padded
    with zeros. Repeated rows are candidates each. With fewer than k candidates all are returned; an
    empty table gives an empty result.
    """
    table, corners = pivot_table(vectors, pivots, key, vector)
    seeds = table.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(SEEDS).collect()
    dims, spark = corners.shape[1], vectors.sparkSession
    queries = stored(table.filter(F.col("vec_id") % every == 0).withColumn("turn", F.monotonically_increasing_id()), "pivot-queries")
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    edges = queries.withColumn("block", F.pmod(F.xxhash64("turn"), F.lit(blocks)))
    out = spark.createDataFrame([], "query_id long, turn long, vec_id long, score long")
    for b in range(blocks):
        rows = edges.filter(F.col("block") == b).collect()        # about QUERY_BLOCK rows
        turn = [r["turn"] for r in rows]
        own = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        q = _matrix(pd.Series([bytes(r["q"]) for r in rows], dtype=object), dims)
        dq = np.array([np.frombuffer(r["to_pivots"]) for r in rows]).reshape(len(rows), len(corners))
        sent = spark.sparkContext.broadcast((turn, own, q, dq, _floors(q, own, seeds, k)))

        def nearest(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            turn, own, q, dq, floor = sent.value
            have: list[list] = [[] for _ in own]
            q2 = (q * q).sum(1)
            for f in frames:
                if not len(f):
                    continue
                c, ids = _matrix(f["q"], dims), f["vec_id"].to_numpy()
                dc = np.ascontiguousarray(np.array([np.frombuffer(x) for x in f["to_pivots"]]).T)
                c2 = (c * c).sum(1)
                c, fast = _floating(c, q)
                for i in range(len(own)):
                    low = np.zeros(len(c))
                    for p in range(len(dc)):
                        np.maximum(low, np.abs(dc[p] - dq[i, p]), out=low)
                    low = np.maximum(low - 1e-6 * (1 + low), 0)              # rounding of the distances
                    have[i] = _best(fast[i], own[i], c, ids, (q2[i] + c2 - low * low) / 2 + 1, floor[i], have[i], k)
            rows = [(o, t, i, s) for o, t, h in zip(own, turn, have, strict=True) for s, i in h]
            yield pd.DataFrame(rows, columns=["query_id", "turn", "vec_id", "score"]).astype("int64")

        out = out.unionByName(table.mapInPandas(nearest, out.schema))
    w = Window.partitionBy("turn").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
