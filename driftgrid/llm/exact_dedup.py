"""Exact dedup by distributed MSD radix partitioning; equality is decided on the bytes themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import stored

WHITE = " \t\n\x0b\x0c\r"


def squeezed(text: Column) -> Column:
    """Text without spaces, tabs and line ends; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False,
                first: int = 64, widen: int = 16) -> DataFrame:
    """Groups of texts that are equal after white space is deleted.

    Every round splits the open groups by the next bytes of their texts (64, then 1,024, 16,384 ... bytes).
    A group of one row, or whose texts have ended, is closed. Rounds grow with the logarithm of the
    longest text; only rows that still share all bytes so far move on, so most texts move once. A round
    counts (group, next bytes) with map-side combine and joins the few groups of several rows back; a
    group that holds a third of all rows is one key of that join, which adaptive execution splits.

    Of a group the row with most code points in the original text stays, then the smallest key (null
    last), then the first row. Returns one row per input row: key, keep_id, group_size, kept,
    text_sha256; with carry also `row`, the whole input row as a struct. Null texts are empty and form a
    group with empty and all-white texts; a repeated row is one more member of its group, and exactly one
    row of a group has kept = true. An empty table gives an empty result.
    """
    body = F.col("row")[text] if carry else F.col("text")
    live = docs.select(F.lit(0).cast("long").alias("group"), F.monotonically_increasing_id().alias("rid"),
                       F.col(key).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
                       F.unhex(F.sha2(squeezed(F.col(text)), 256)).alias("sha"),
                       *([F.struct("*").alias("row")] if carry else [F.col(text).alias("text")]))
    names = live.columns
    singles, groups = [], []
    at, width, level = 0, first, 0
    while True:
        raw = squeezed(body).cast("binary")
        cut = live.withColumns({"head": F.substring(raw, at + 1, width), "ended": F.length(raw) <= at + width})
        heads = stored(cut.groupBy("group", "ended", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                       .select("group", "ended", "head", F.monotonically_increasing_id().alias("next")), "radix-heads")
        out = cut.join(heads.hint("merge"), ["group", "ended", "head"], "left")
        going = F.col("next").isNotNull() & ~F.col("ended")
        out = stored(out.select(*[F.col(c) for c in names if c not in ("group", "text")], F.col("next").alias("group"), "ended",
                                *([] if carry else [F.when(going, F.col("text")).alias("text")])), "radix-rows")
        singles.append(out.filter(F.col("group").isNull()))
        groups.append(out.filter(F.col("group").isNotNull() & F.col("ended")).withColumn("level", F.lit(level)))
        live = out.filter(F.col("group").isNotNull() & ~F.col("ended")).select(*names)
        if live.isEmpty():
            break
        at, width, level = at + width, width * widen, level + 1

    more = ["row"] if carry else []
    alone = reduce(DataFrame.unionByName, singles).select(
        F.col("id").alias(key), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *more)
    members = reduce(DataFrame.unionByName, groups)
    rank = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "rid")
    best = stored(members.groupBy("level", "group").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
                  .select("level", "group", "group_size", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid")), "radix-best")
    shared = members.join(best.hint("merge"), ["level", "group"]).select(
        F.col("id").alias(key), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), *more)
    return alone.unionByName(shared)


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each group of equal texts, with docs' own columns."""
    return exact_dedup(docs, key, text, carry=True).filter("kept").select("row.*")
