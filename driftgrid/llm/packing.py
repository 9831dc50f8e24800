"""Token packing: shortest-pack-first over the length histogram, patterns joined back by rank."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.common import chunks, stored
from driftgrid.llm.tokens import ByteTokens

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, key: str = "doc_id",
                 text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids plus end_id, cut every `size` ids.

    One row per piece: doc_id, start, length, ids_crc32 (ids as little-endian unsigned 32-bit), doc_tokens;
    with_ids adds the ids as such bytes. Null texts are empty: a single piece with end_id alone.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = ByteTokens(vocabulary)
        end = np.uint32(end_id).tobytes()
        for f in chunks(frames, "text"):
            out = []
            for doc, text_ in zip(f["doc_id"], f["text"], strict=True):
                ids = coder.encode(text_ if isinstance(text_, str) else "") + end
                n = len(ids) // 4
                for a in range(0, n, size):
                    part = ids[4 * a:4 * (a + size)]
                    out.append((doc, a, len(part) // 4, zlib.crc32(part), n, *([part] if with_ids else [])))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, PIECE + (", ids binary" if with_ids else ""))


def pack_patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: (count, lengths) patterns for a histogram of lengths.

    Lengths are placed longest first into the shortest open pack; if even that has no room, new packs are
    opened, each with as many of the length as fit. Packs with the same content are one pattern with a count.
    """
    done: list[tuple[int, tuple[int, ...]]] = []
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    totals: list[int] = []

    def put(count: int, pattern: tuple[int, ...], total: int) -> None:
        if count <= 0:
            return
        if total == size:
            done.append((count, pattern))
        elif total in packs:
            packs[total].append((count, pattern))
        else:
            packs[total] = [(count, pattern)]
            heapq.heappush(totals, total)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if totals and totals[0] + length <= size:
                total = totals[0]
                count, pattern = packs[total].pop()
                if not packs[total]:
                    del packs[total]
                    heapq.heappop(totals)
                take = min(left, count)
                put(count - take, pattern, total)
                put(take, (*pattern, length), total + length)
                left -= take
            else:
                fit = size // length
                put(left // fit, (length,) * fit, length * fit)
                put(1 if left % fit else 0, (length,) * (left % fit), length * (left % fit))
                left = 0
    return done + [x for same in packs.values() for x in same]


def ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """pieces with `rank`, gapless from 0 among pieces of the same length, and the length histogram.

    Pieces are dealt by hash into about sqrt(n) buckets; a bucket's ranks start after the earlier buckets
    of its length. A length that holds a third of all pieces is spread over all buckets.
    """
    n = pieces.count()
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(1, int(n ** 0.5)))))
    counts = stored(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    out = (dealt.withColumn("place", F.row_number().over(inside) - 1).join(base, ["length", "bucket"])
           .withColumn("rank", F.col("base") + F.col("place")).drop("base", "place", "bucket"))
    return out, {length: c for length, c in counts.groupBy("length").agg(F.sum("n")).collect()}


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """pieces (doc_id, start, length up to size, ids_crc32, ...) with sequence_id and offset, both long.

    Only the histogram, at most `size` counts, comes to the driver. The patterns found there are a table of
    rank ranges: (length, first rank) -> (first sequence, offset); its rows are positions in patterns, bounded
    by size and not by the number of pieces. Each piece finds its range by length and rank. Ties and
    repeated pieces get ranks of their own. No pieces, no rows.
    """
    numbered, histogram = ranked(pieces)
    cursor: dict[int, int] = {}
    ranges, sequence = [], 0
    for count, pattern in pack_patterns(histogram, size):
        offset = 0
        for length in pattern:
            ranges.append((length << 50 | cursor.get(length, 0), sequence, offset))
            cursor[length] = cursor.get(length, 0) + count
            offset += length
        sequence += count
    firsts, sequences, offsets = (np.array(x, dtype=np.int64) for x in zip(*sorted(ranges), strict=True)) if ranges else (np.zeros(0, np.int64),) * 3

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        want = (length.to_numpy() << 50) | rank.to_numpy()
        at = np.searchsorted(firsts, want, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + want - firsts[at], "offset": offsets[at]})

    return numbered.withColumn("at", place("length", "rank")).select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents cut into pieces and packed; the pieces are written once and then only counted and placed."""
    return pack(stored(token_pieces(docs, vocabulary, size, end_id, key, text), "pack-pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order (bytes), from pieces that kept their ids; no row exceeds size ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.transform(parts, lambda p: p["ids"]).alias("parts"))
