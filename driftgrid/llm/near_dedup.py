"""Near-duplicates by Order MinHash with verification by banded alignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import stored

WORDS, SIMILAR = 5, 0.8
DRAWS, KEEP = 24, 3
BINS, BLOCK = 256, 64
SLIDE = 4096
BAGS, CELLS = 4093, 1 << 20
SHARES = (1 / 64, 1 / 8, 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64)


def word_ids(text: str) -> np.ndarray:
    """32-bit hash of each white-space-separated word of the lowered text."""
    words = text.lower().split()
    return (pd.util.hash_array(np.array(words, dtype=object), categorize=False) >> np.uint64(32)).astype(np.uint32) if words else np.zeros(0, np.uint32)


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """64-bit hash of every run of k words; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    w, out = words.astype(np.uint64), np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ w[i:len(w) - k + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return out


def order_minhash(s: np.ndarray, draws: int = DRAWS, keep: int = KEEP) -> list[int]:
    """One 64-bit value per draw: the `keep` smallest occurrence-labelled shingles, in text order.

    The n-th occurrence of a shingle is labelled n, so repeats count; text order makes the value
    sensitive to moves, as edit similarity is.
    """
    n = len(s)
    by = np.argsort(s, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(s[by]) != 0) + 1])
    label = np.empty(n, dtype=np.uint64)
    label[by] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    base = (s ^ (label * np.uint64(0xC2B2AE3D27D4EB4F))) * MIX
    base ^= base >> np.uint64(31)
    out, keep, step = [], min(keep, n), max(1, CELLS // n)
    for j in range(0, draws, step):                      # as many draws at once as CELLS values hold
        seeds = SEEDS[j:min(j + step, draws), None]
        h = (base ^ seeds) * MIX
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        at, row = np.empty((len(seeds), keep), np.int64), np.arange(len(seeds))
        for i in range(keep):
            at[:, i] = h.argmin(1)
            h[row, at[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        v = seeds[:, 0] ^ np.uint64(keep)
        for i in np.sort(at, axis=1).T:
            v = (v ^ base[i]) * MIX
            v ^= v >> np.uint64(29)
        out += v.view(np.int64).tolist()
    return out


def in_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches lie within the band.

    One bit for each position of b, a zero where a match ends. Only bits inside the band can change: those
    below are settled, those above are still ones, so a window is held that moves SLIDE positions at a
    time. Positions of a word are a slice of one sorted array; a word at more than 1 / 1024 of b has a
    mask, and there are fewer than 2,048 of these. Memory is linear in the text.
    """
    m = len(b)
    by = np.argsort(b, kind="stable")
    first, end = np.searchsorted(b[by], a, "left"), np.searchsorted(b[by], a, "right")
    met = np.flatnonzero(end > first)
    where, masks, few = by.tolist(), {}, m >> 10
    wide = (1 << (2 * band + 1)) - 1
    v = base = top = settled = turn = 0
    for i, s, e in zip(met.tolist(), first[met].tolist(), end[met].tolist(), strict=True):
        if i >= turn:
            low, high = min(max(i - band, 0), m), min(i + SLIDE + band + 1, m)
            v |= ((1 << (high - top)) - 1) << (top - base)
            settled += low - base - (v & ((1 << (low - base)) - 1)).bit_count()
            v >>= low - base
            base, top, turn = low, high, i + SLIDE
            full = (1 << (top - base)) - 1
        if e - s == 1:
            j = where[s]
            if not -band <= j - i <= band:
                continue
            hit = 1 << (j - base)
        elif e - s <= few:
            hit = 0
            for j in where[s:e]:
                if -band <= j - i <= band:
                    hit |= 1 << (j - base)
        else:
            hit = masks.get(s)
            if hit is None:
                bits = np.zeros(m, np.uint8)
                bits[by[s:e]] = 1
                hit = masks[s] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            low = i - band - base
            hit = hit >> base & (wide << low if low > 0 else wide >> -low)
        u = v & hit
        v = ((v + u) | (v - u)) & full
    return settled + top - base - v.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Words matched in order over words in either: common / (|a| + |b| - common); 0 if it can't reach `least`.

    The alignment is banded: at similarity `least` two matched positions differ by at most the number of
    unmatched words, so nothing outside the band can matter. Words that both have at all, in any order, bound
    those in order, so most pairs that can't reach `least` are not aligned.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    top = min(n, m)
    same = a[:top] == b[:top]
    head = top if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    top = min(len(a), len(b))
    same = a[len(a) - top:][::-1] == b[len(b) - top:][::-1]
    tail = top if same.all() else int(same.argmin())
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    common = head + tail
    if len(a) and len(b):
        both = np.minimum(*(np.bincount((x % x.dtype.type(BAGS)).astype(np.int64), minlength=BAGS) for x in (a, b))).sum()
        if common + both < least * (n + m - common - both):
            return 0.0
        common += in_order(a, b, int((n + m) * (1 - least) / (1 + least)) + 1)
    s = common / (n + m - common)
    return s if s >= least else 0.0


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each connected component, for the nodes of links (u, v).

    Every round each node hooks to its smallest neighbour, the edges are contracted to the hooks, and
    duplicates vanish by map-side combine; rounds grow with the logarithm of the longest chain.
    """
    edges = stored(links.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-edges")
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "near-hooks")
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("top"))
        hook = stored(hook.join(up, "p").select("u", F.col("top").alias("p")), "near-hooks")
        left, right = hook.select("u", F.col("p").alias("pu")), hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = stored(edges.join(left, "u").join(right, "v").filter("pu != pv")
                       .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "near-edges")
        step = hook.select(F.col("u").alias("comp"), F.col("p").alias("next"))
        total = stored(hook.select(F.col("u").alias("node"), F.col("p").alias("comp")) if total is None else
                       total.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "near-labels")
    return total if total is not None else links.select(F.col("u").alias("node"), F.col("v").alias("comp")).limit(0)


def card_type(draws: int) -> np.dtype:
    """What a block holds of a node: its digest, number of words, draws, folded word counts, and component."""
    return np.dtype([("node", ">u8", 2), ("n", "<i8"), ("bands", "<i8", draws), ("bins", "u1", BINS), ("comp", ">u8", 2)])


def folded(words: np.ndarray) -> bytes:
    """Words counted in BINS bins, 255 at most: bins that differ tell how many words two texts can't share at least."""
    return np.minimum(np.bincount((words >> np.uint32(24)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _sketch(draws: int, keep: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, mark, text in zip(f["key"], f["mark"], f["text"], strict=True):
                w = word_ids(text if isinstance(text, str) else "")
                s = shingles(w)
                if not len(s):
                    out.append((doc, mark, None, 0, [], None))
                    continue
                node = hashlib.blake2b(" ".join(text.lower().split()).encode(errors="surrogatepass"), digest_size=16).digest()
                bands = order_minhash(s, draws, keep)
                out.append((doc, mark, node, len(w), bands, node + np.array([len(w), *bands], dtype="<i8").tobytes() + folded(w)))
            yield pd.DataFrame(out, columns=["key", "mark", "node", "n", "bands", "card"])
    return run


def _candidates(draws: int, similar: float, whole: bool):
    """Pairs of a block of probes and a block of targets that may be similar: other component, lengths and
    folded counts within reach, and no earlier bucket that both share. whole: a pair of probes counts once."""
    kind = card_type(draws)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for bucket, big, probes, targets in zip(f["bucket"], f["big"], f["probes"], f["targets"], strict=True):
                p, t = np.frombuffer(b"".join(probes), kind), np.frombuffer(b"".join(targets), kind)
                n, m = p["n"][:, None], t["n"][None]
                ok = (p["comp"][:, None] != t["comp"][None]).any(-1) & (np.minimum(n, m) >= similar * np.maximum(n, m))
                if whole:
                    (a, b), (x, y) = p["node"].T[..., None], t["node"].T[:, None]
                    probe = (t["comp"] != np.frombuffer(big, ">u8")).any(-1)
                    ok &= ~probe[None] | (a < x) | (a == x) & (b < y)
                i, j = np.nonzero(ok)
                same = p["bands"][i] == t["bands"][j]
                at = same.argmax(1)
                here = p["bands"][i, at] == bucket
                i, j = i[here], j[here]
                for width in (4, 1):                     # bins in fours first: cheaper, and leaves few pairs
                    x, y = (c["bins"].reshape(len(c), -1, width).sum(2, dtype=np.int16) for c in (p, t))
                    near = np.abs(x[i] - y[j]).sum(1) <= (p["n"][i] + t["n"][j]) * (1 - similar) / (1 + similar) + 1e-6
                    i, j = i[near], j[near]
                if len(i):
                    yield pd.DataFrame({"node": [x.tobytes() for x in p["node"][i]], "lead": [x.tobytes() for x in t["node"][j]],
                                        "comp": [x.tobytes() for x in p["comp"][i]], "lead_comp": [x.tobytes() for x in t["comp"][j]]})
    return run


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep, blobs = [], []
        for text in f["text"]:
            w = word_ids(text if isinstance(text, str) else "")
            keep.append(hashlib.blake2b(" ".join(text.lower().split()).encode(errors="surrogatepass"), digest_size=16).digest() if len(w) else None)
            blobs.append(w.tobytes())
        yield pd.DataFrame({"node": keep, "words": blobs})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR,
                    draws: int = DRAWS, keep: int = KEEP) -> DataFrame:
    """key, class_id (smallest key of the class), class_size, kept, mark (xxhash64 of the text) for every row.

    Two texts are linked if their words, aligned in order, match with similarity 0.8 or more (`aligned`, words
    in common over words in either); classes are the connected components. Texts with the same lowered words
    are one node from the start. A node enters one bucket per Order MinHash draw of its five-word shingles. In
    every bucket all nodes are first aligned with one leader (the same order of nodes everywhere, so a large
    family has one leader and repeated pairs vanish). In a bucket that still holds several components, the nodes
    outside its largest one are probes; they meet 1/64, then 1/8, then all nodes of other components. Blocks of
    probes meet blocks of targets, and only pairs whose lengths and folded word counts leave 0.8 possible are
    emitted, each in the first bucket that both share. So every two texts that share a draw are in one class,
    were aligned, or are provably less similar; nothing is capped.
    A changed word changes five shingles. Two texts with a share p of their words changed at random places share
    a draw with a chance of about J^3, J = q / (2 - q) and q = (1 - p)^5: at word similarity 0.9 (p = 0.053) no
    draw of 24 is shared with a chance of 0.2 %, at 0.85 of 5 %, at 0.8 of 25 %. A changed passage hurts less.

    Null, empty and white texts have no shingles: each is a class of its own. kept is true for one row
    of each class (smallest key, null last, then first row); repeated rows are members like others.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, mark long, node binary, n long, bands array<long>, card binary"
    rows = stored(source.select("key", F.xxhash64("text").alias("mark"), "text").mapInPandas(_sketch(draws, keep), schema)
                  .withColumn("rid", F.monotonically_increasing_id()), "near-rows")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    entries = nodes.select("node", "n", F.xxhash64("node").alias("turn"), F.explode("bands").alias("bucket"))
    several = stored(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket"), "near-buckets")
    named = stored(entries.join(several.hint("merge"), "bucket").withColumn("comp", F.col("node")), "near-entries")
    met = named.select("node").distinct()
    cards = stored(rows.filter("node is not null").groupBy("node").agg(F.first("card").alias("card")).join(met.hint("merge"), "node"), "near-cards")
    words = stored(source.select("text").mapInPandas(_words, "node binary, words binary").groupBy("node").agg(F.first("words").alias("words"))
                   .join(met.hint("merge"), "node"), "near-words")

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similar) for x, y in zip(a, b, strict=True)], dtype=float)

    def joined(named: DataFrame, pairs: DataFrame) -> DataFrame:
        """named with the components that the links among pairs (node, lead, comp, lead_comp) bring together."""
        a, b = words.select("node", F.col("words").alias("a")), words.select(F.col("node").alias("lead"), F.col("words").alias("b"))
        links = pairs.join(a.hint("merge"), "node").join(b.hint("merge"), "lead").filter(similarity("a", "b") >= similar)
        step = components(links.select(F.col("comp").alias("u"), F.col("lead_comp").alias("v"))).select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        return stored(named.join(step, "comp", "left").select("bucket", "node", "n", "turn", F.coalesce("next", "comp").alias("comp")), "near-named")

    lead = named.groupBy("bucket").agg(F.min(F.struct("turn", "node", "n")).alias("m")).select("bucket", F.col("m.node").alias("lead"), F.col("m.n").alias("lead_n"))
    stars = (named.join(lead.hint("merge"), "bucket").filter((F.col("node") != F.col("lead")) & (F.least("n", "lead_n") >= similar * F.greatest("n", "lead_n")))
             .select("node", "lead").distinct())
    named = joined(named, stars.withColumns({"comp": F.col("node"), "lead_comp": F.col("lead")}))
    for share in SHARES:
        parts = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
        open_ = stored(parts.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
                       .select("bucket", F.col("m.comp").alias("big"), F.expr("size - m.c").alias("rest"), "size"), "near-open")
        if open_.isEmpty():
            break
        met_now = F.expr(f"pmod(shiftright(turn, 8), 64) < {round(64 * share)}")
        part = named.join(open_.hint("merge"), "bucket").filter((F.col("comp") != F.col("big")) | met_now)     # others have no part in this round
        live = stored(part.join(cards.hint("merge"), "node")
                      .select("bucket", "turn", "big", "rest", "size", (F.col("comp") != F.col("big")).alias("probe"), F.concat("card", "comp").alias("body")), "near-live")
        probes = (live.filter("probe").groupBy("bucket", "big", F.expr(f"pmod(turn, ceil(rest / {BLOCK}))").alias("block")).agg(F.collect_list("body").alias("probes")).drop("block"))
        targets = (live.filter(met_now)
                   .groupBy("bucket", F.expr(f"pmod(shiftright(turn, 16), ceil(size * {share} / {BLOCK}))").alias("block")).agg(F.collect_list("body").alias("targets")).drop("block"))
        pairs = probes.join(targets.hint("merge"), "bucket").select("bucket", "big", "probes", "targets")
        pairs = pairs.mapInPandas(_candidates(draws, similar, share == 1), "node binary, lead binary, comp binary, lead_comp binary")
        named = joined(named, pairs if share == 1 else pairs.distinct())
    comps = named.select("node", "comp").distinct()

    member = rows.select("key", "mark", "rid", "node")
    member = member.join(comps, "node", "left")
    own = F.concat(F.lit(b"row"), F.col("rid").cast("string").cast("binary"))
    member = stored(member.select("key", "mark", "rid", F.coalesce("comp", "node", own).alias("comp")), "near-members")
    heads = stored(member.groupBy("comp").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid")).alias("m"))
                   .select("comp", "class_size", F.col("m.key").alias("class_id"), F.col("m.rid").alias("head")), "near-heads")
    return member.join(heads, "comp").select(F.col("key").alias(key), "class_id", "class_size", (F.col("rid") == F.col("head")).alias("kept"), "mark")


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, one of each class. Rows that repeat id and text stay or go together."""
    gone = stored(near_duplicates(docs, key, text, **options).filter("kept").select(F.col(key).alias("_near_key"), F.col("mark").alias("_near_mark")), "near-kept")
    return docs.join(gone, docs[key].eqNullSafe(gone["_near_key"]) & (F.xxhash64(docs[text]) == gone["_near_mark"]), "left_semi")
