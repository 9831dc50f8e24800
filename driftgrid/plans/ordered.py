"""Prefix scans over (key, order) that never put a whole key in one task.

A plain window puts every row of a key in one task. Here the order axis is cut into spans, of fixed
width where the order is a time step, or by the counts of the rows (plans/spans.py) where it is an id or a value:
each (key, span) is reduced to one total with map-side combine, the totals (smaller than the rows
by the span) are scanned per key, and each span gets its carry back as one extra seed row that
sorts first. The row-level window then runs per (key, span), so a key that holds a third of the
table is spread over as many tasks as it has spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.plans.spans import with_spans

STEP_SPAN = 4096        # time steps per span; (key, step) is unique in tracks

_FOLD = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min,
         "row": F.last, "last": lambda c: F.last(c, ignorenulls=True),
         "first": lambda c: F.first(c, ignorenulls=True)}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(kind: str, value: Column, order: Column) -> Column:
    if kind == "row":
        return F.max_by(value, order)
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    if kind == "first":
        return F.min_by(value, F.when(value.isNotNull(), order))
    return _FOLD[kind](value)


def running(df: DataFrame, keys, order: str, folds: dict, *, ties=(), before: bool = False,
            span: int | None = STEP_SPAN, **depth) -> DataFrame:
    """Add one running value per entry of folds = {name: (kind, column)}.

    kind is sum, count, max, min, last or first (the last two skip nulls), or row, the last row's
    value even when null. before=True excludes the current row, so row is then lag. Values of order are unique
    per key, or unique together with the ties columns; with ties, rows of one order value must be few.

    span is the fixed width of spans on an integral order: at most 2^19 of them for a 32-bit step, whatever the
    steps are. None cuts spans by counts (span_rows and most in depth, see plans/spans.py), for ids and values of any
    spread; a key that fits one span is then an ordinary window, and an integral or floating order will do.
    """
    keys = list(keys)
    folds = {n: ("count" if k == "count" else k, F.lit(1).cast("long") if k == "count" else _col(c))
             for n, (k, c) in folds.items()}
    tmp = {n: f"__in_{n}" for n in folds}
    frame = (Window.unboundedPreceding, -1 if before else 0)
    if span is None:
        cut_up = with_spans(df, keys, order, **depth)
        if cut_up is None:
            w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(order), *[_col(t) for t in ties]).rowsBetween(*frame)
            return df.select("*", *[_FOLD[k](c).over(w).alias(n) for n, (k, c) in folds.items()])
    else:
        cut_up = df.withColumn("__span", F.expr(f"cast(`{order}` as bigint) div {span}"))
    rows = cut_up.select("*", F.lit(False).alias("__seed"), *[c.alias(tmp[n]) for n, (_, c) in folds.items()])
    # A tie-broken order is compared as a struct, so the last value is the one the window sees last.
    rank = F.struct(F.col(order), *[_col(t) for t in ties]) if ties else F.col(order)
    totals = rows.groupBy(*keys, "__span").agg(
        *[_total(k, F.col(tmp[n]), rank).alias(tmp[n]) for n, (k, _) in folds.items()])
    earlier = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__span")
               .rowsBetween(Window.unboundedPreceding, -1))
    seeds = totals.select(*keys, "__span", F.lit(True).alias("__seed"),
                          *[_FOLD[k](F.col(tmp[n])).over(earlier).alias(tmp[n])
                            for n, (k, _) in folds.items()])
    w = (Window.partitionBy(*keys, "__span")
         .orderBy(F.col("__seed").desc(), F.col(order), *[_col(t) for t in ties])
         .rowsBetween(*frame))
    out = rows.unionByName(seeds, allowMissingColumns=True)
    return (out.select("*", *[_FOLD[k](F.col(tmp[n])).over(w).alias(n) for n, (k, _) in folds.items()])
            .filter(~F.col("__seed")).drop("__span", "__seed", *tmp.values()))


def scan(df: DataFrame, keys, order: str, *, local, totals, state, apply, span: int = STEP_SPAN) -> DataFrame:
    """A prefix scan with several dependent steps that still reads its input only twice.

    Chaining running() doubles the reads with every link. Here the links are stacked windows on one
    partitioning by (key, span):
      local(rows, w)      adds in-span running columns
      totals              aggregates of them per span (no further shuffle)
      state(spans, cw)    turns the totals into the state before each span; cw is the frame of the
                          earlier spans of the key
      apply(rows, w)      adds the results; the state arrives as one seed row per span, marked
                          by __seed, that sorts before the span's rows
    """
    keys = list(keys)
    rows = df.select("*", F.expr(f"cast(`{order}` as bigint) div {span}").alias("__span"), F.lit(False).alias("__seed"))
    w = (Window.partitionBy(*keys, "__span").orderBy(F.col("__seed").desc(), F.col(order)).rowsBetween(Window.unboundedPreceding, 0))
    cw = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = local(rows, w).groupBy(*keys, "__span").agg(*totals)
    seeds = state(spans, cw).withColumn("__seed", F.lit(True))
    out = apply(rows.unionByName(seeds, allowMissingColumns=True), w)
    return out.filter(~F.col("__seed"))


def previous(df: DataFrame, keys, order: str, cols: dict, *, span: int = STEP_SPAN) -> DataFrame:
    """Lag by one row: cols = {new_name: column}; null on a key's first row."""
    return running(df, keys, order, {n: ("row", c) for n, c in cols.items()}, before=True, span=span)


def ranked(df: DataFrame, keys, order: str, name: str = "rank", *, ties=(), span: int | None = None, **depth) -> DataFrame:
    """1-based row number per key in order, without gathering a key; ids may be as sparse as they like."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, ties=ties, span=span, **depth)


def ranked_by_value(df: DataFrame, keys, value: str, tie: str, name: str = "rank", *, descending: bool = False, **depth) -> DataFrame:
    """1-based rank by a numeric value, ties by the integral column tie.

    Distinct values are counted and scanned for the offset of each value; rows of one value are
    ranked by tie. Both scans cut their spans by counts, so neither a key nor a popular value nor a crowded
    stretch of values has to fit one task.
    """
    keys = list(keys)
    sign = F.lit(-1.0) if descending else F.lit(1.0)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__axis", F.col(value) * sign)
    ahead = running(counts, keys, "__axis", {"__ahead": ("sum", F.col("__n"))}, before=True, span=None, **depth)
    inner = ranked(df, [*keys, value], tie, "__pos", **depth)
    return (inner.join(ahead.select(*keys, value, "__ahead"), [*keys, value])
            .withColumn(name, F.coalesce("__ahead", F.lit(0)) + F.col("__pos")).select(*df.columns, name))


TICKS = 1 << 32         # ticks of a 32-bit uniform
_BUCKET = 1 << 12       # ticks per bucket: about a million buckets


def nth_smallest(df: DataFrame, tick: str, tie: str, n: int):
    """(tick, tie) of the n-th row in (tick, tie) order, or None with fewer than n rows.

    Rows are counted per bucket of ticks, and only the bucket that holds the n-th row is ranked.
    """
    b = df.withColumn("__b", F.expr(f"{tick} div {_BUCKET}"))
    counts = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    at = (running(counts, [], "__b", {"__cum": ("sum", F.col("__n"))}).filter(F.col("__cum") >= n)
          .agg(F.min(F.struct("__b", "__cum", "__n")).alias("m")).first()["m"])
    if at is None:
        return None
    k = n - (at["__cum"] - at["__n"])
    row = ranked(b.filter(F.col("__b") == at["__b"]), [], tick, "__k", ties=[tie], span=1).filter(F.col("__k") == k).select(tick, tie).first()
    return tuple(row)
