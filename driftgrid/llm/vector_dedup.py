"""Embedding near-dedup: int8 tile products with quantisation error bounds, full precision only for pairs that may link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import stored
from driftgrid.llm.near_dedup import components

LEAST = 0.93
STRIP, TILE, PAIRS = 4096, 1024, 1 << 16
DIMS = 1024                                          # 127 * 127 * 1024 < 2^24: such sums are exact in single precision


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes q, scale s and error e of the unit vectors of the rows of x: |x / |x| - s q| <= e."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - scale[:, None] * q, axis=1) + 1e-12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of int8 rows: single-precision products of up to DIMS components don't round."""
    out = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= DIMS else np.float64)
    for d in range(0, a.shape[1], DIMS):
        out += a[:, d:d + DIMS].astype(np.float32) @ b[:, d:d + DIMS].astype(np.float32).T
    return out


def possible(qa, sa, ea, qb, sb, eb, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile whose cosine may reach `least`.

    With x = x' + dx and y = y' + dy, |dx| <= ea and |dy| <= eb, xy differs from x'y' by at most
    |x| |dy| + |dx| |y'| <= eb + ea (1 + eb), as x and y are unit vectors.
    """
    near = products(qa, qb) * sa[:, None] * sb[None]
    return np.nonzero(near + ea[:, None] * (1 + eb[None]) + eb[None] >= least - 1e-9)


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j: the larger root hooks to the smaller until all agree; roots point to themselves."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (root[root] != root).any():
            root[:] = root[root]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as rows in double precision, each scaled by a power of two so that no square overflows."""
    values = column.combine_chunks()
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, scales, errors = [], [], []
        for v in batch.column("v"):                  # lengths may differ from row to row
            x = np.array(v.as_py(), dtype=np.float64)[None]
            q, s, e = quantised(np.ldexp(x, -np.frexp(np.abs(x).max())[1]))
            codes.append(q.tobytes())
            scales.append(s[0])
            errors.append(e[0])
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("v"), batch.column("n"), pa.array(codes, pa.binary()),
                                          pa.array(scales, pa.float64()), pa.array(errors, pa.float64())], ["node", "label", "v", "n", "code", "scale", "error"])


def _tiles(least: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, n, side = (group.column(c).to_numpy() for c in ("node", "n", "side"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        x = _matrix(group.column("v"))
        norm = np.linalg.norm(x, axis=1)
        q = np.frombuffer(b"".join(group.column("code").to_pylist()), np.int8).reshape(len(node), -1)
        s, e = group.column("scale").to_numpy(), group.column("error").to_numpy()
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        for p in range(0, len(left), TILE):
            a = left[p:p + TILE]
            for r in range(p if low == high else 0, len(right), TILE):
                b = right[r:r + TILE]
                i, j = possible(q[a], s[a], e[a], q[b], s[b], e[b], least)
                i, j = a[i], b[j]
                if low == high:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), PAIRS):
                    u, w = i[k:k + PAIRS], j[k:k + PAIRS]
                    ok = np.einsum("ij,ij->i", x[u], x[w]) / (norm[u] * norm[w]) >= least
                    u, w = u[ok], w[ok]
                    np.add.at(links, u, n[w])
                    np.add.at(links, w, n[u])
                    united(root, u, w)
        met = np.flatnonzero(links)
        return pa.table({"node": node[met], "links": links[met], "root": node[root[met]]})
    return run


def usable(vector: Column, label: Column) -> Column:
    """Neither null, all finite, and not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 least: float = LEAST, strip: int = STRIP) -> DataFrame:
    """key, n_links, component_id, kept for every row: vectors of one label with a cosine of `least` or more are linked.

    Equal vectors of a label are one node with a weight from the start, so a vector that fills a third of the table
    costs one row. Nodes of a label are dealt into strips of about `strip`; each pair of strips is one group of a
    shuffle, so a hot label spreads over the square of its strips and no task holds more than two strips. Inside, int8 products of
    tiles with an error bound for each vector leave the pairs that may reach `least`, and only those are computed in double
    precision: no link is lost and none is below. A tile hands out a link count and one tree edge per vector, never its pairs.
    The number of products is quadratic in the distinct vectors of a label, as an exact join by cosine needs here.

    Rows with a null label, or whose vector is null, zero, empty or holds null or non-finite components, link with nothing; so do
    vectors of different lengths. component_id is the smallest key reachable (null only if all are null), kept says that it is the
    row's own. Repeated rows link with each other. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label")).withColumn("ok", usable(F.col("v"), F.col("label")))
    nodes = stored(rows.filter("ok").groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
                   .withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    sizes = nodes.groupBy("label", F.size("v").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / strip).cast("int").alias("strips"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    codes = stored(nodes.select("node", "label", "v", "n").mapInArrow(_codes, f"node long, label {kinds['label']}, v {kinds['v']}, n long, code binary, scale double, error double"), "vector-codes")
    dealt = (codes.withColumn("dims", F.size("v")).join(sizes, ["label", "dims"])
             .withColumn("side", F.pmod(F.xxhash64("node"), F.col("strips")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
             .select("label", "dims", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "n", "v", "code", "scale", "error"))
    met = stored(dealt.groupBy("label", "dims", "low", "high").applyInArrow(_tiles(least), "node long, links long, root long"), "vector-links")
    comps = components(met.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = (nodes.join(links, "node", "left").join(comps, "node", "left")
             .select("label", "v", "id", F.coalesce("comp", "node").alias("comp"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    tops = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    known = named.join(tops, "comp").select("label", "v", "n_links", "component_id")
    linked = rows.filter("ok").join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
