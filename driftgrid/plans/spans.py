"""Spans of an ordered axis, cut where the rows are, so that no span holds much more than its share.

Ids may be dense, hashed, time-based or clustered, and values may crowd anywhere on their axis. Cuts are
therefore taken from the rows: a counted sample gives equi-depth bounds, and every row finds its span by
binary search in them. Bounds only spread work; results never depend on them. They are fixed before any
plan uses them, so every branch of a plan sees the same spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.plans.lineage import cut

SPAN_ROWS = 1 << 16     # rows that one span may hold before it is cut
MOST = 1024             # spans of the whole table, or of one key, at most; beyond, spans grow
PER_SPAN = 256          # sampled rows per span: spans differ by some 6 percent


def place(value: Column, bounds: Column, most: int = MOST) -> Column:
    """How many of the ascending bounds are not above value, by binary search."""
    steps = [F.lit(1 << k) for k in reversed(range(most.bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= value, at + s).otherwise(at))


def _equi_depth(taken: DataFrame, keys: list[str], spans: int) -> DataFrame:
    """(keys..., __bounds): the values of __order that cut the rows taken of each key into spans of equal size."""
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    at = F.row_number().over(own.orderBy("__order")) * spans / F.count(F.lit(1)).over(own)
    numbered = taken.select(*keys, "__order", F.floor(at).alias("__at"))
    firsts = numbered.filter(F.col("__at").between(1, spans - 1)).groupBy(*keys, "__at").agg(F.min("__order").alias("__order"))
    return firsts.groupBy(*keys).agg(F.array_sort(F.collect_set("__order")).alias("__bounds"))


def table_bounds(df: DataFrame, order: Column, span_rows: int = SPAN_ROWS, most: int = MOST) -> list:
    """Bounds that cut the whole table into spans of about span_rows rows, from one count and one sampled pass."""
    n = df.count()
    spans = min(most, -(-n // span_rows))
    if spans < 2:
        return []
    share = min(1.0, spans * PER_SPAN / n)
    rows = df.select(order.alias("__order"))
    found = _equi_depth(rows if share == 1.0 else rows.sample(share, 1), [], spans).first()
    return found["__bounds"] if found else []


def hot_bounds(df: DataFrame, keys: list[str], order: Column, span_rows: int = SPAN_ROWS, most: int = MOST) -> DataFrame | None:
    """(keys..., __bounds) of the keys with more than span_rows rows, or None if there are none.

    At most one key in span_rows rows is here, with at most `most` bounds cut from at most most * PER_SPAN sampled rows.
    """
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > span_rows)
    if big.isEmpty():
        return None
    rows = matched(df.select(*keys, order.alias("__order")), cut(big), keys, "inner")
    taken = rows.filter(F.rand(1) < F.lit(float(most * PER_SPAN)) / F.col("__n"))
    return cut(_equi_depth(taken, keys, most))


def matched(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows with the other columns of table at equal keys; null equals null."""
    own = table.withColumnsRenamed({k: f"__at_{k}" for k in keys})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__at_{k}")) for k in keys])
    return rows.join(own, on, how).drop(*[f"__at_{k}" for k in keys])


def with_spans(df: DataFrame, keys: list[str], order: str, span_rows: int = SPAN_ROWS, most: int = MOST) -> DataFrame | None:
    """df with __span, which rises with order inside a key; None if neither a key nor the table needs more than one span."""
    if not keys:
        bounds = table_bounds(df, F.col(order), span_rows, most)
        return df.withColumn("__span", place(F.col(order), F.array(*[F.lit(b) for b in bounds]), most)) if bounds else None
    hot = hot_bounds(df, keys, F.col(order), span_rows, most)
    if hot is None:
        return None
    out = matched(df, hot, keys, "left").withColumn("__span", F.coalesce(place(F.col(order), F.col("__bounds"), most), F.lit(0)))
    return out.drop("__bounds")
