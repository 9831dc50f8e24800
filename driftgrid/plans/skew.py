"""Equi joins whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.plans.spans import SPAN_ROWS

HOT_KEYS = 1000         # keys that can hold more than one part in HOT_KEYS of the rows: there are fewer


def shuffled(table: DataFrame) -> DataFrame:
    """table for a join that sorts and shuffles both sides, whatever the optimizer guesses of its size.

    The guess is the file's compressed size, cut down by columns, and knows of no generator, so a table of millions of rows
    passes for a few megabytes and would be broadcast: built in the driver and held by every task.
    """
    return table.hint("merge")


def split_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined with table on the column key, with rows of a hot key dealt to several tasks.

    Keys are counted (with map-side combine). Those above one part in HOT_KEYS of the rows, fewer than HOT_KEYS by that
    definition, are broadcast with their number of shares; their rows are dealt over the shares by a hash of the row, and
    table's rows of these keys are repeated for each share. rows is read twice, so hand in a written one.
    """
    n = rows.count()
    limit = max(SPAN_ROWS, n // HOT_KEYS)
    if n <= limit:
        return rows.join(shuffled(table), key, how)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__shares"))
    hot = F.broadcast(hot.limit(HOT_KEYS))
    one = F.coalesce("__shares", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__share", F.pmod(F.xxhash64(*rows.columns), one).cast("int")).drop("__shares")
    held = table.join(hot, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), one - 1))).drop("__shares")
    return dealt.join(shuffled(held), [key, "__share"], how).drop("__share")
