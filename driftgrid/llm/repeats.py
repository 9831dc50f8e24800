"""Repeated byte strings across a corpus: anchors find them, enhanced suffix arrays delimit them exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from driftgrid.llm.common import chunks, discard, lean_batches, stored, trim

GRAM = 64
CROWD = 4096                                         # open contexts of one anchor that go through one interval tree
HELD = 4096                                          # contexts that Python hands back at once
INK = np.ones(256, dtype=np.int8)                    # 0: white space
INK[[9, 10, 11, 12, 13, 32]] = 0
LETTER = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x5851F42D4C957F2D)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = np.uint64(28)
SLOT_MASK = np.uint64((1 << 28) - 1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_choices(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the position of the least (leftmost); h shorter than width: none."""
    n = len(h)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    tagged = (h & ~SLOT_MASK) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = tagged
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
    return (least & SLOT_MASK).astype(np.int64)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least value (leftmost) of some window of `width` values; h shorter than width: none."""
    at = window_choices(h, width)
    return at[np.concatenate([[True], np.diff(at) != 0])] if len(at) else at


class Anchors:
    """Anchors of a text: 64-byte strings chosen by content so that every string of `length` bytes holds one.

    Both places of a repeated string choose the same anchor in it. For each anchor: its hash, position, and a
    hash of its context, the bytes that any string of `length` bytes around it can reach.
    """

    def __init__(self, length: int):
        self.length, self.reach = length, length - GRAM
        self.up, self.down = powers(BASE, 1 << 16), powers(BACK, 1 << 16)

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        if n < self.length:
            return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        if n > len(self.up):
            self.up, self.down = powers(BASE, n * 2), powers(BACK, n * 2)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(LETTER[np.frombuffer(data, dtype=np.uint8)] * self.up[:n], out=total[1:])
        grams = mixed((total[GRAM:] - total[:-GRAM]) * self.down[:n - GRAM + 1])
        at = window_minima(grams, self.reach + 1)
        lo, hi = np.maximum(at - self.reach, 0), np.minimum(at + self.length, n)
        around = mixed((total[hi] - total[lo]) * self.down[lo])
        around = mixed(around ^ ((at - lo).astype(np.uint64) << np.uint64(20)) ^ (hi - at).astype(np.uint64))
        return grams[at], at, around


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words, runs of bytes other than ASCII white space."""
    ink = np.zeros(len(data) + 2, dtype=np.int8)
    ink[1:-1] = INK[np.frombuffer(data, dtype=np.uint8)]
    edge = np.diff(ink)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class WordRuns:
    """Hashes of the runs of `words` words of a text, each with its anchor: the least of the shorter runs in it.

    Equal runs choose equal anchors, so a run can only occur elsewhere if its anchor does.
    """

    def __init__(self, words: int):
        self.words, self.gram = words, (words + 1) // 2
        self.up, self.down = powers(BASE, 1 << 16), powers(BACK, 1 << 16)

    def hashes(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo:hi], for each pair."""
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:len(values)], out=total[1:])
        return mixed((total[hi] - total[lo]) * self.down[lo])

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Per run, by its first word: the run's hash and its anchor's."""
        start, stop = word_bounds(data)
        n = len(start)
        if n < self.words:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(data) > len(self.up):
            self.up, self.down = powers(BASE, len(data) * 2), powers(BACK, len(data) * 2)
        word = mixed(self.hashes(LETTER[np.frombuffer(data, dtype=np.uint8)], start, stop) ^ (stop - start).astype(np.uint64))
        short, whole = np.arange(n - self.gram + 1), np.arange(n - self.words + 1)
        grams = self.hashes(word, short, short + self.gram)
        return self.hashes(word, whole, whole + self.words), grams[window_choices(grams, self.words - self.gram + 1)]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each interval of the LCP tree, inner ones first, by one scan with a stack.

    lcp[i] is the common prefix of suffixes i and i + 1 in sorted order.
    """
    stack: list[tuple[int, int]] = []          # (depth, first)
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(places: list[tuple[bytes, bytes]], least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats through one anchor: (left reach, right reach, all places), left + right >= least.

    places: (bytes before the anchor reversed, bytes from the anchor on). The suffixes from the anchor on are
    sorted into an enhanced suffix array; each interval of its LCP tree is a string that its places share
    to the right. Within an interval the left extensions are sorted the same way: an interval of theirs is
    shared to the left as well, and its left end is maximal since its extensions differ there. Intervals run
    from deep to shallow; a repeat whose places all lie in longer repeats to both sides is left out.
    """
    order = np.array(sorted(range(len(places)), key=lambda i: places[i][1]))
    lcp = [common_prefix(places[a][1], places[b][1]) for a, b in zip(order, order[1:], strict=False)]
    by_left = np.argsort(np.array(sorted(range(len(places)), key=lambda i: places[i][0])))      # rank of each place by left bytes
    size = np.array([len(p[0]) for p in places])
    best_left, best_right = np.full(len(places), -1), np.full(len(places), -1)
    for right, first, last in lcp_intervals(lcp):
        inside = order[first:last + 1]
        if right + size[inside].max() < least:
            continue
        inside = inside[np.argsort(by_left[inside])]
        left = [common_prefix(places[a][0], places[b][0]) for a, b in zip(inside, inside[1:], strict=False)]
        for reach, a, b in lcp_intervals(left):
            who = inside[a:b + 1]
            if reach + right >= least and ((best_left[who] < reach) | (best_right[who] < right)).any():
                best_left[who], best_right[who] = np.maximum(best_left[who], reach), np.maximum(best_right[who], right)
                yield reach, right, who


def sorted_reach(rows: DataFrame, side: str, other: str, name: str) -> tuple[DataFrame, DataFrame]:
    """rows with `name`, how many bytes of column `side` each row shares at most with any other row of its anchor,
    and `name`_with, how many bytes of `other` it shares with the neighbour that shares so many; and the written table behind it.

    A distributed suffix sort: rows are range-partitioned and sorted by (anchor, bytes), so an anchor of any
    size spreads over tasks, and the longest common prefix is with a neighbour. The two end rows of a
    task meet their neighbours of the next task on the driver: two rows per task.
    """
    cols = ["a", side, other, "d1", "d2", "pos"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn("part", F.spark_partition_id())
    names = ordered.columns
    schema = StructType([*ordered.schema.fields, StructField("best", LongType()), StructField("edge", IntegerType())])

    def shared(a1: int, s1: bytes, o1: bytes, a2: int, s2: bytes, o2: bytes) -> int:
        return common_prefix(s1, s2) << 32 | common_prefix(o1, o2) if a1 == a2 else 0

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        held, mark, before = None, 1, 0            # the last row so far waits for its next neighbour; mark 1: first of the task
        for f in frames:
            if not len(f):
                continue
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            keys = list(zip(f["a"], f[side], f[other], strict=True))
            link = [shared(*x, *y) for x, y in zip(keys, keys[1:], strict=False)]
            edge = np.zeros(len(f), dtype=np.int32)
            edge[0] = mark
            ready = f.assign(best=np.maximum([before, *link], [*link, 0]), edge=edge)
            held, mark, before = f.iloc[-1:][names], int(edge[-1]), (link[-1] if link else before)
            if len(f) > 1:
                yield ready.iloc[:-1]
        if held is not None:
            yield held.assign(best=before, edge=mark | 2)

    out = stored(ordered.mapInPandas(scan, schema), "repeat-reach")
    ends = sorted(out.filter("edge > 0").select("part", "edge", "a", side, other).collect(), key=lambda r: (r["part"], r["edge"]))
    patch = [(-1, -1, 0)]
    for x, y in zip(ends, ends[1:], strict=False):
        if x["part"] != y["part"]:
            n = shared(x["a"], bytes(x[side]), bytes(x[other]), y["a"], bytes(y[side]), bytes(y[other]))
            patch += [(x["part"], x["edge"], n), (y["part"], y["edge"], n)]
    more = rows.sparkSession.createDataFrame(patch, "part int, edge int, more long").groupBy("part", "edge").agg(F.max("more").alias("more"))
    best = F.greatest("best", F.coalesce("more", F.lit(0)))
    reached = (out.join(F.broadcast(more), ["part", "edge"], "left")        # two rows per task at most
               .withColumns({name: F.shiftright(best, 32), f"{name}_with": best.bitwiseAND(F.lit((1 << 32) - 1))}).drop("part", "edge", "best", "more"))
    return reached, out


def _key(text: str = "text"):
    return [F.xxhash64(F.col(text)).alias("d1"), (F.shiftleft(F.octet_length(text).cast("long"), 32).bitwiseOR(F.crc32(F.col(text).cast("binary")))).alias("d2")]


def _packed(texts: DataFrame) -> DataFrame:
    """Texts compressed before they are exchanged."""
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trim()
        z = zstandard.ZstdCompressor(level=1)
        for s in frames:
            yield pd.Series([z.compress(t.encode()) for t in s], dtype=object)
    return texts.withColumn("blob", F.pandas_udf(run, "binary")("text")).drop("text")


def _anchors(length: int, words: int | None):
    """Anchors of byte strings with their places; of runs of words too, once a text, at -1."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, runs = Anchors(length), WordRuns(words) if words else None
        for f in chunks(frames, "text"):
            out = []
            for d1, d2, t in zip(f["d1"], f["d2"], f["text"], strict=True):
                a, at, b = finder.find(t.encode())
                if runs:
                    more = np.unique(runs.find(t.encode())[1])
                    a, at, b = np.concatenate([a, more]), np.concatenate([at, np.full(len(more), -1)]), np.concatenate([b, np.zeros_like(more)])
                out.append(pd.DataFrame({"d1": np.full(len(a), d1, np.int64), "d2": np.full(len(a), d2, np.int64), "pos": at, "a": a.view(np.int64), "b": b.view(np.int64)}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return run


def _contexts(length: int, words: int | None):
    """Bytes around the wanted places; and the hashes h of the runs of words around the wanted anchors of runs.

    Contexts of near places overlap, so a batch of texts has many times its bytes in them; at most HELD are handed back at once.
    """
    reach, names = length - GRAM, ["a", "d1", "d2", "pos", "full", "left", "right", "h"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        z, runs = zstandard.ZstdDecompressor(), WordRuns(words) if words else None
        for f in frames:
            out = []
            for d1, d2, blob, places, grams in zip(f["d1"], f["d2"], f["blob"], f["places"], f["grams"], strict=True):
                data = z.decompress(blob)
                for p in places:
                    out.append((p["a"], d1, d2, p["pos"], p["full"], data[max(0, p["pos"] - reach):p["pos"]][::-1], data[p["pos"]:p["pos"] + length], None))
                    if len(out) == HELD:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if len(grams):
                    h, a = (x.view(np.int64) for x in runs.find(data))
                    pos = np.flatnonzero(np.isin(a, grams))
                    for at in np.split(pos, range(1 << 16, len(pos), 1 << 16)):
                        yield pd.DataFrame({"a": a[at], "d1": np.full(len(at), d1, np.int64), "d2": np.full(len(at), d2, np.int64), "pos": at,
                                            "full": None, "left": None, "right": None, "h": h[at]})
            yield pd.DataFrame(out, columns=names)
    return run


def _groups(length: int):
    """Spans of the repeats through each anchor; rows come by anchor, and only those of one anchor are held from batch to batch."""
    def spans(d1: np.ndarray, d2: np.ndarray, pos: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, ...]:
        reach = np.zeros((2, len(pos)), dtype=np.int64)             # all repeats of a place hold its anchor: their union is one span
        for before, after, who in maximal_repeats(list(zip(left, right, strict=True)), length):
            reach[0, who], reach[1, who] = np.maximum(reach[0, who], before), np.maximum(reach[1, who], after)
        hit = np.flatnonzero(reach.sum(axis=0) >= length)
        return d1[hit], d2[hit], pos[hit] - reach[0, hit], pos[hit] + reach[1, hit]

    def settled(f: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
        keys, (left, right) = [f[c].to_numpy() for c in ("d1", "d2", "pos")], (f[c].tolist() for c in ("left", "right"))
        out = [spans(*(k[a:b] for k in keys), left[a:b], right[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("d1", "d2", "start", "stop"), zip(*out, strict=True), strict=True)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        held = None                                # the last anchor so far may go on in the next batch
        for f in frames:
            if not len(f):
                continue
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            edges = [0, *(np.flatnonzero(np.diff(f["a"].to_numpy())) + 1).tolist()]
            if len(edges) > 1:
                yield settled(f, edges)
            held = f.iloc[edges[-1]:]
        if held is not None:
            yield settled(held, [0, len(held)])
    return run


def shared_runs(runs: DataFrame) -> DataFrame:
    """Per text the first words of those runs that also stand in another text: d1, d2, runs. Places within one text are no repeat here."""
    doc = F.struct("d1", "d2")
    again = runs.groupBy("a", "h").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")).filter("lo != hi").select("a", "h")
    return runs.join(again.hint("merge"), ["a", "h"]).groupBy("d1", "d2").agg(F.collect_list("pos").alias("runs"))


def repeated_spans(texts: DataFrame, length: int = 400, most: int = CROWD, words: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Covered spans (d1, d2, start, stop), possibly overlapping, of the distinct texts, (d1, d2, copies), and with `words` the shared runs.

    texts: (d1, d2, text), text not null. A text with copies is covered whole and keeps one row as a partner
    for others. An anchor with at most `most` open contexts goes through the interval tree within one task; one with more is
    settled by counting strings, spread over tasks.
    """
    long_ = texts.filter(F.octet_length("text") >= (min(length, 2 * words - 1) if words else length))
    found = stored(long_.mapInPandas(_anchors(length, words), "d1 long, d2 long, pos long, a long, b long"), "repeat-anchors")
    place = F.xxhash64("d1", "d2", "pos")
    again = stored(found.groupBy("a").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo != hi").select("a"), "repeat-again")
    every, found = found, stored(found.join(again.hint("merge"), "a"), "repeat-found")
    discard(every, again)
    grams, found = found.filter("pos < 0"), found.filter("pos >= 0")
    several = stored(found.groupBy("a", "b").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.min(F.struct("d1", "d2", "pos")).alias("at"))
                     .select("a", "b", (F.col("lo") != F.col("hi")).alias("full"), "at.*"), "repeat-contexts")
    reach = length - GRAM
    whole = found.join(several.filter("full").select("a", "b").hint("merge"), ["a", "b"]).select(
        "d1", "d2", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), F.least(F.col("pos") + length, F.shiftright("d2", 32)).alias("stop")).filter(F.col("stop") - F.col("start") >= length)

    open_ = several.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("full")).alias("some")).filter("n > 1 and some").select("a")
    wanted = several.join(open_.hint("merge"), "a").select("d1", "d2", F.struct("a", "pos", "full").alias("place"), F.lit(None).cast("long").alias("gram"))
    if words:
        wanted = wanted.unionByName(grams.select("d1", "d2", F.col("a").alias("gram")), allowMissingColumns=True)
    wanted = stored(wanted.groupBy("d1", "d2").agg(F.collect_list("place").alias("places"), F.collect_list("gram").alias("grams")), "repeat-wanted")
    blobs = _packed(long_).groupBy("d1", "d2").agg(F.first("blob").alias("blob"))
    context = stored(blobs.join(wanted.hint("merge"), ["d1", "d2"]).select("d1", "d2", "blob", "places", "grams").mapInPandas(
        _contexts(length, words), "a long, d1 long, d2 long, pos long, full boolean, left binary, right binary, h long"), "repeat-bytes")
    discard(wanted)
    runs = stored(shared_runs(context.filter("h is not null").select("a", "h", "d1", "d2", "pos")), "repeat-runs") if words else None
    reached, right = sorted_reach(context.filter("h is null").drop("h"), "right", "left", "r")
    discard(context)
    reached, both = sorted_reach(reached, "left", "right", "l")
    discard(right)
    reached = reached.filter(F.col("l") + F.col("r") >= length)
    met = (F.col("r") + F.col("r_with") >= length) & (F.col("l") + F.col("l_with") >= length)        # both bounds are reached by repeats
    cut = stored(reached.select("a", "d1", "d2", "pos", (met | F.col("full")).alias("met"), F.expr("substring(left, 1, int(l))").alias("left"),
                                F.expr("substring(right, 1, int(r))").alias("right")), "repeat-cut")
    discard(both)
    shared = cut.filter("met").select("d1", "d2", (F.col("pos") - F.length("left")).alias("start"), (F.col("pos") + F.length("right")).alias("stop"))
    rest = cut.filter("not met").select("a").distinct()
    same = (cut.join(rest.hint("merge"), "a").groupBy("a", "left", "right").agg(F.min(F.struct("d1", "d2", "pos", "met")).alias("at"), F.count(F.lit(1)).alias("n"))
            .select("a", "left", "right", "n", "at.*"))
    same = stored(same, "repeat-same")
    twins = cut.filter("not met").join(same.filter("n > 1").select("a", "left", "right").hint("merge"), ["a", "left", "right"])
    twins = twins.select("d1", "d2", (F.col("pos") - F.length("left")).alias("start"), (F.col("pos") + F.length("right")).alias("stop"))
    open_ = (F.col("n") == 1) & ~F.col("met")
    nl, nr = F.length("left"), F.length("right")
    sizes = stored(same.groupBy("a").agg(F.count(F.lit(1)).alias("size"), F.max(open_).alias("some"), F.min(F.when(open_, length - nr)).alias("lo"),
                                         F.max(F.when(open_, nl)).alias("hi")).filter("some and size > 1").drop("some"), "repeat-sizes")
    few = same.join(sizes.filter(F.col("size") <= most).select("a").hint("merge"), "a").select("a", "d1", "d2", "pos", "left", "right")
    single = few.repartition("a").sortWithinPartitions("a").mapInPandas(_groups(length), "d1 long, d2 long, start long, stop long")
    # A crowded anchor is not gathered: an open place and a partner share a string of `length` bytes around the anchor, and only the few strings
    # that lie within the reach of some open place are compared, by counting.
    many = same.join(sizes.filter(F.col("size") > most).hint("merge"), "a")
    low, high = F.greatest(F.col("lo"), length - nr), F.least(F.col("hi"), nl)
    many = many.withColumn("s", F.explode(F.when(low <= high, F.sequence(low, high))))
    window = F.unhex(F.sha2(F.concat(F.expr("substring(left, 1, s)"), F.expr(f"substring(right, 1, {length} - s)")), 256))
    many = many.select("a", "s", window.alias("h"), "n", "d1", "d2", "pos", open_.alias("open"))
    again = many.groupBy("a", "s", "h").agg(F.sum("n").alias("c")).filter("c > 1").select("a", "s", "h")
    crowded = many.filter("open").join(again.hint("merge"), ["a", "s", "h"], "left_semi").select("d1", "d2", (F.col("pos") - F.col("s")).alias("start"), (F.col("pos") + length - F.col("s")).alias("stop"))
    single = single.unionByName(crowded)
    spans = reduce(DataFrame.unionByName, [whole, shared, twins, single])
    copies = texts.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"))
    return spans.groupBy("d1", "d2", "start").agg(F.max("stop").alias("stop")), copies, runs


def merged(spans, size: int) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined, within 0 to size."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, s["start"]), min(size, s["stop"])) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def run_spans(data: bytes, runs: np.ndarray, words: int) -> list[dict[str, int]]:
    """Byte spans of the runs of `words` words that begin at these words; overlapping ones joined."""
    start, stop = word_bounds(data)
    runs = np.sort(runs)
    new = np.concatenate([[True], np.diff(runs) >= words])
    first, last = runs[new], runs[np.concatenate([new[1:], [True]])]
    return [{"start": int(start[a]), "stop": int(stop[b + words - 1])} for a, b in zip(first, last, strict=True)]


def without_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", carry: bool = False,
                    most: int = CROWD, words: int | None = None, as_text: bool = False) -> DataFrame:
    """Every byte covered by a string of `length` bytes that also starts elsewhere is removed, at all its places.

    Texts are UTF-8 bytes; strings don't cross texts and are judged on the input. Per row: key, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 and kept (the remaining bytes; as_text: as a text, without the characters
    that a span cuts); with carry also `row`, the input row. Null texts are empty; texts shorter than `length` stay whole; repeated rows remove each other.

    1. Anchors by window minima: each string of `length` bytes holds one, the same at all its places. Only anchors
    that occur again go on. 2. An anchor whose whole context occurs again is settled by counting. 3. For the rest a
    distributed suffix sort to either side tells how far each place agrees with any other; contexts are
    cut there, and equal ones are settled. 4. What is left, few different contexts per anchor, goes through
    an enhanced suffix array whose interval tree gives the maximal repeats with all their places; an anchor with more than `most`
    of them compares strings by counting instead. With `words` every run of so many words that also stands in another
    row goes too, however few bytes it has; white space between words may differ. An empty table gives no rows. The session is left with
    small batches to Python (`lean_batches`), since the result is read after this returns. Places are counted in 28 bits, so a text holds less than 2^28 bytes.
    """
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    rows = rows.select(*_key(), *rows.columns)
    spans, copies, shared = repeated_spans(rows.select("d1", "d2", "text"), length, most, words)
    side = copies.join(spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).hint("merge"), ["d1", "d2"], "left")
    side = side.join(shared.hint("merge"), ["d1", "d2"], "left") if words else side.withColumn("runs", F.lit(None).cast("array<long>"))
    side = stored(side, "repeat-spans")

    def covered(data: bytes, spans, runs, n: int) -> list[tuple[int, int]]:
        if n > 1 and len(data) >= length:
            return [(0, len(data))]
        spans = list(spans) if spans is not None else []
        if words and n > 1 and (at := len(word_bounds(data)[0]) - words) >= 0:
            runs = np.arange(at + 1)
        return merged(spans + run_spans(data, runs, words) if runs is not None else spans, len(data))

    def cut(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        trim()
        z = zstandard.ZstdDecompressor()
        for blobs, all_spans, all_runs, counts in frames:
            out = []
            for blob, spans, runs, n in zip(blobs, all_spans, all_runs, counts, strict=True):
                data = z.decompress(blob) if len(blob) else b""
                gone = covered(data, spans, runs, n)
                edges = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if as_text else kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    udf = F.pandas_udf(cut, f"n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}")
    if carry:
        rows = rows.withColumn("row", F.col("row").withField(text, F.lit(None).cast("string")))
    out = _packed(rows).join(side.hint("merge"), ["d1", "d2"], "left").withColumn("c", udf("blob", "spans", "runs", "copies"))
    return out.select(F.col("key").alias(key), "c.*", *(["row"] if carry else []))


def without_repeats_text(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """docs with repeats removed from their text; all rows stay. A character cut by a span goes whole; a null text stays null.

    With `words` runs of so many words that stand in another row too go as well. n_chars, where docs has it, becomes the new number of characters of a text that changed.
    """
    marked = docs.select("*")
    out = without_repeats(marked.select(F.struct("*").alias("own"), F.col(text).alias("text"), F.col(key).alias("key")), length, "key", "text", carry=True, words=words, as_text=True)      # decoded by the same Python: a second step would take a second worker a core, and workers stay
    out = out.select(F.col("row.own").alias("own"), "n_bytes", "n_removed", F.when(F.col("n_bytes") > 0, F.col("kept")).alias("new"))
    cols = []
    for c in docs.columns:
        old = F.col("own")[c]
        cols.append((F.when(F.col("n_bytes") > 0, F.col("new")).otherwise(old) if c == text else
                     F.when(F.col("n_removed") > 0, F.length("new").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old).alias(c))
    return out.select(*cols)
