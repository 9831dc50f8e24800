"""Fill-in-middle transformation: cuts at word boundaries, found on a wavelet matrix over character classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SLICE = 8 << 20                                     # bytes of text that one matrix covers (a longer text has its own)
SINGLE, OPENS, INSIDE, TAIL = range(4)              # classes of a byte: other character, first letter of a run, later letter, UTF-8 continuation
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, low = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))


class WaveletMatrix:
    """Class codes split bit by bit from the highest; each level keeps its bits and moves the zeros in front of the ones."""

    def __init__(self, codes: np.ndarray, levels: int = 2):
        self.levels = []
        for level in reversed(range(levels)):
            bit = (codes >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), len(bit) - int(bit.sum())))
            codes = np.concatenate([codes[~bit], codes[bit]])

    def rank(self, code: int, i: np.ndarray) -> np.ndarray:
        """How many of the first i codes equal `code`."""
        lo, hi = np.zeros_like(i), i
        for level, bits, zeros in self.levels:
            if code >> level & 1:
                lo, hi = zeros + bits.rank(lo), zeros + bits.rank(hi)
            else:
                lo, hi = lo - bits.rank(lo), hi - bits.rank(hi)
        return hi - lo


def classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of texts laid end to end; no run of letters goes on over a start."""
    letter = (raw | 32) - np.uint8(97) < 26
    inside = np.zeros(len(raw), bool)
    inside[1:] = letter[1:] & letter[:-1]
    inside[starts[starts < len(raw)]] = False
    out = np.where(letter, np.where(inside, np.uint8(INSIDE), np.uint8(OPENS)), np.uint8(SINGLE))
    out[raw & 0xC0 == 0x80] = TAIL
    return out


def cut_places(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, characters before the first cut, characters before the second) of texts laid end to end.

    Boundaries below a place are the ranks of single characters and of opened runs together. Text by text, but for
    all texts at once, bisection on these ranks finds the byte at which token number k starts, and the rank of
    continuation bytes turns bytes into characters.
    """
    matrix = WaveletMatrix(classes(raw, starts))

    def boundaries(i: np.ndarray) -> np.ndarray:
        return matrix.rank(SINGLE, i) + matrix.rank(OPENS, i)

    base = boundaries(starts)
    n = boundaries(ends) - base
    tails = matrix.rank(TAIL, starts)
    places = []
    for units in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        lo, hi = starts.copy(), ends.copy()             # the first byte with more than `units` boundaries up to it; the end if none
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            over = boundaries(np.minimum(mid + 1, ends)) - base > units
            lo, hi = np.where((lo < hi) & ~over, mid + 1, lo), np.where((lo < hi) & over, mid, hi)
        places.append(lo - starts - (matrix.rank(TAIL, lo) - tails))
    return n, *places


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    text = text.cast(pa.large_binary())
    h1, h2 = (h.to_numpy(zero_copy_only=False) for h in (h1, h2))
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    body, done, at = text.buffers()[2], [], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[to])
        raw = np.frombuffer(body, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
        done.append(cut_places(raw, offsets[at:to] - low, offsets[at + 1:to + 1] - low, h1[at:to], h2[at:to]))
        at = to
    columns = [np.concatenate(c) for c in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four keyed integers below 2^32: the first 8-digit groups of the SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Texts with a middle part moved to the end, one row per input row: key, n, form, prefix_chars, middle_chars, output.

    A text has n tokens, runs of ASCII letters or single other characters. Two keyed draws choose the boundaries at
    which prefix and middle end. `rate` of 100 texts are transformed, `spm` of 100 of these with the suffix first.
    form is psm, spm or plain; a plain output is the text itself, with null prefix_chars and middle_chars.

    Null texts are empty. Empty texts, and those that hold a marker already, stay plain, so `restored` is exact. Rows
    with equal key and text give equal rows; a null key draws as an empty one. A text is cut on its own bytes, with a few bytes of
    rank tables a byte, so its length is bounded by the row alone. Other columns are not read; an empty table gives no rows.
    """
    h = draws(F.col("key"), seed)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"h1": h[0], "h2": h[1], "h3": h[2], "h4": h[3]}).withColumn("cut", _cuts("text", "h1", "h2"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("key", "text", F.col("cut.n").alias("n"), form.alias("form"), F.col("cut.first").cast("int").alias("a"), F.col("cut.second").cast("int").alias("b"))
    prefix, middle = F.substr("text", F.lit(1), F.col("a")), F.substr("text", F.col("a") + 1, F.col("b") - F.col("a"))
    suffix = F.substr("text", F.col("b") + 1)
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    cut = F.col("form") != "plain"
    return rows.select(F.col("key").alias(key), "n", "form", F.when(cut, F.col("a").cast("long")).alias("prefix_chars"),
                       F.when(cut, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` made output from. No part holds a marker, so each marker's first place is its own."""
    def between(left: str, right: str | None) -> Column:
        start = F.instr(output, left) + len(left)
        return F.substr(output, start, F.instr(output, right) - start) if right else F.substr(output, start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
