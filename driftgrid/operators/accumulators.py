"""Updaters of per-individual accumulator columns.

Each scalar updater is a Column expression; update(df, acc, mask, value) writes it where the mask
holds. Updaters that need other rows (groups, territories, layers) are DataFrame transforms whose
aggregates are reduced before they are joined back.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions import num
from driftgrid.functions.rand import Key, hash_u
from driftgrid.operators.filters import combo_mask, tick_of, up_to
from driftgrid.plans.lineage import cut
from driftgrid.plans.ordered import nth_smallest, ranked

log = logging.getLogger(__name__)


def update(df: DataFrame, acc: str, value: Column, mask: Column | None = None) -> DataFrame:
    new = value if mask is None else F.when(mask, value).otherwise(F.col(acc))
    return df.withColumn(acc, new)


def set_clamped(value, lo=None, hi=None) -> Column:
    return num.clamp(value, lo, hi)


def clear(lo=None) -> Column:
    return F.lit(max(0.0, lo) if lo is not None else 0.0)


def increment(acc: str, amount: float, lo=None, hi=None) -> Column:
    return num.clamp(F.col(acc) + F.lit(float(amount)), lo, hi)


def stochastic_increment(acc: str, low: float, high: float, seed: int, key: Key = "agent_id",
                         lo=None, hi=None) -> Column:
    u = hash_u(seed, "increment", key)
    return num.clamp(F.col(acc) + (F.lit(float(low)) + F.lit(float(high - low)) * u), lo, hi)


def expression(expr, lo=None, hi=None) -> Column:
    """A Spark expression; NaN becomes 0, infinities the bound on their side or 0, then clamp."""
    value = (F.expr(expr) if isinstance(expr, str) else expr).cast("double")
    return num.clamp(num.finite_or_bound(value, lo, hi), lo, hi)


def time_step(t, modulus: int | None = None) -> Column:
    step = F.col(t) if isinstance(t, str) else F.lit(t)
    return (F.pmod(step, F.lit(modulus)) if modulus and modulus > 0 else step).cast("double")


def individual_id(key: str = "agent_id") -> Column:
    return F.col(key).cast("double")


def stochastic_trigger(p: float, seed: int, key: Key = "agent_id") -> Column:
    return F.when(hash_u(seed, "acc.trigger", key) < p, 1.0).otherwise(0.0)


def individual_location() -> Column:
    return F.col("cell").cast("double")


def trait_index(trait: str) -> Column:
    return F.col(trait).cast("double")


def transfer(df: DataFrame, src: str, tgt: str, fraction: float = 1.0, mask: Column | None = None,
             src_bounds=(None, None), tgt_bounds=(None, None)) -> DataFrame:
    """Move a fraction of src to tgt; tgt receives exactly what left src."""
    if src == tgt:
        raise ValueError("source and target accumulator are the same column")
    mask = F.lit(True) if mask is None else mask
    new_src = num.clamp(F.col(src) - F.col(src) * F.lit(float(fraction)), *src_bounds)
    new_tgt = num.clamp(F.col(tgt) + (F.col(src) - new_src), *tgt_bounds)
    return df.withColumns({src: F.when(mask, new_src).otherwise(F.col(src)),
                           tgt: F.when(mask, new_tgt).otherwise(F.col(tgt))})


# --- layers ---------------------------------------------------------------------------------

def with_layer(df: DataFrame, layer: DataFrame, value: str, name: str = "__layer") -> DataFrame:
    """Value of layer(cell_id, value) at each row's cell; null off the layer."""
    return df.join(layer.select(F.col("cell_id").alias("cell"), F.col(value).alias(name)), "cell", "left")


def quantify_location(df: DataFrame, acc: str, layer: DataFrame, value: str, mask=None) -> DataFrame:
    new = F.coalesce(F.col("__layer"), F.lit(0.0))
    return update(with_layer(df, layer, value), acc, new, mask).drop("__layer")


def quantify_extremes(df: DataFrame, acc: str, layer: DataFrame, value: str, mode: str = "max",
                      history: DataFrame | None = None, mask=None) -> DataFrame:
    """Extreme layer value over the visited cells; without a history, the current cell's value."""
    if history is None:
        return quantify_location(df, acc, layer, value, mask)
    pick = {"max": F.max, "min": F.min}[mode]
    seen = (with_layer(history.select("agent_id", "cell").distinct(), layer, value)
            .groupBy("agent_id").agg(pick("__layer").alias("__ext")))
    new = F.coalesce(F.col("__ext"), F.lit(0.0))
    return update(df.join(seen, "agent_id", "left"), acc, new, mask).drop("__ext")


def presence(df: DataFrame, acc: str, layer: DataFrame, value: str, threshold: float = 0.0, mask=None) -> DataFrame:
    new = F.when(num.gt(F.col("__layer"), threshold), 1.0).otherwise(0.0)
    return update(with_layer(df, layer, value), acc, new, mask).drop("__layer")


def uptake(df: DataFrame, acc: str, layer: DataFrame, value: str, rate: float = 1.0, lo=None, hi=None, mask=None):
    """Every row gains rate x the original layer value; the layer loses the unclamped sum.

    The loss per cell is the original value times rate times the head count, so only counts are
    aggregated. Returns (rows, layer).
    """
    mask = F.lit(True) if mask is None else mask
    gain = F.coalesce(F.col("__layer"), F.lit(0.0)) * F.lit(float(rate))
    rows = update(with_layer(df, layer, value), acc, num.clamp(F.col(acc) + gain, lo, hi), mask).drop("__layer")
    heads = df.filter(mask).groupBy(F.col("cell").alias("cell_id")).agg(F.count(F.lit(1)).alias("__heads"))
    left = (layer.join(heads, "cell_id", "left")
            .withColumn(value, F.col(value) - F.col(value) * F.lit(float(rate)) * F.coalesce("__heads", F.lit(0)))
            .drop("__heads"))
    return rows, left


# --- territories and history ------------------------------------------------------------------

def allocated_count(df: DataFrame, acc: str, ranges: DataFrame, mask=None) -> DataFrame:
    own = ranges.groupBy(F.col("owner").alias("agent_id")).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    return update(df.join(own, "agent_id", "left"), acc, F.coalesce("__n", F.lit(0.0)), mask).drop("__n")


def explored_count(df: DataFrame, acc: str, history: DataFrame, approximate: bool = False, mask=None) -> DataFrame:
    """Distinct visited cells per individual (visits are deduplicated before they are counted)."""
    if approximate:
        seen = history.groupBy("agent_id").agg(F.approx_count_distinct("cell").cast("double").alias("__n"))
    else:
        seen = (history.select("agent_id", "cell").distinct().groupBy("agent_id")
                .agg(F.count(F.lit(1)).cast("double").alias("__n")))
    return update(df.join(seen, "agent_id", "left"), acc, F.coalesce("__n", F.lit(0.0)), mask).drop("__n")


def resources_allocated(df: DataFrame, acc: str, ranges: DataFrame, layer: DataFrame, value: str, mask=None) -> DataFrame:
    own = (ranges.join(layer.select("cell_id", F.col(value).alias("__layer")), "cell_id")
           .groupBy(F.col("owner").alias("agent_id")).agg(F.sum("__layer").alias("__n")))
    return update(df.join(own, "agent_id", "left"), acc, F.coalesce("__n", F.lit(0.0)), mask).drop("__n")


def resources_explored(df: DataFrame, acc: str, history: DataFrame, layer: DataFrame, value: str, mask=None) -> DataFrame:
    seen = (with_layer(history.select("agent_id", "cell").distinct(), layer, value)
            .groupBy("agent_id").agg(F.sum("__layer").alias("__n")))
    return update(df.join(seen, "agent_id", "left"), acc, F.coalesce("__n", F.lit(0.0)), mask).drop("__n")


# --- groups -----------------------------------------------------------------------------------

def group_size(df: DataFrame, acc: str, mask=None) -> DataFrame:
    """Masked members of the row's group, 0 when ungrouped. One reduced row per group is joined."""
    mask = F.lit(True) if mask is None else mask
    sizes = (df.filter(mask & (F.col("group_id") >= 0)).groupBy("group_id")
             .agg(F.count(F.lit(1)).cast("double").alias("__n")))
    new = F.when(F.col("group_id") >= 0, F.coalesce("__n", F.lit(0.0))).otherwise(0.0)
    return update(df.join(sizes, "group_id", "left"), acc, new, mask).drop("__n")


def group_sum(df: DataFrame, acc: str, src: str, mask=None) -> DataFrame:
    """Sum of src over the masked members; ungrouped rows keep their value."""
    mask = F.lit(True) if mask is None else mask
    sums = df.filter(mask & (F.col("group_id") >= 0)).groupBy("group_id").agg(F.sum(src).alias("__n"))
    return update(df.join(sums, "group_id", "left"), acc, F.col("__n"),
                  mask & (F.col("group_id") >= 0)).drop("__n")


def births(df: DataFrame, acc: str, offspring: DataFrame, mask=None) -> DataFrame:
    """Number of offspring(parent_id) rows per individual."""
    n = offspring.groupBy(F.col("parent_id").alias("agent_id")).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    return update(df.join(n, "agent_id", "left"), acc, F.coalesce("__n", F.lit(0.0)), mask).drop("__n")


def mate_verification(df: DataFrame, acc: str, mask=None) -> DataFrame:
    """-1 where the mate id names a known dead individual; unknown ids stay."""
    mask = F.lit(True) if mask is None else mask
    dead = df.filter(~F.col("alive")).select(F.col("agent_id").alias("__mate"), F.lit(True).alias("__dead"))
    mate = F.when(F.isnan(acc), F.lit(None)).otherwise(F.col(acc)).cast("long")
    out = df.withColumn("__mate", mate).join(dead, "__mate", "left")
    return update(out, acc, F.lit(-1.0), mask & (F.col("__mate") >= 0) & F.col("__dead").isNotNull()).drop("__mate", "__dead")


def assign_random_n(df: DataFrame, acc: str, n: int, value: float, seed: int, mask=None) -> DataFrame:
    """min(n, candidates) masked rows, drawn without replacement, get value."""
    mask = F.lit(True) if mask is None else mask
    rows = df.withColumn("__tick", tick_of(hash_u(seed, "assign", "agent_id")))
    cutoff = nth_smallest(rows.filter(mask), "__tick", "agent_id", n)
    chosen = mask if cutoff is None else mask & up_to("__tick", "agent_id", cutoff)
    return update(rows, acc, F.lit(float(value)), chosen).drop("__tick")


def select_first_n_per_group(df: DataFrame, acc: str, n: int, value: float, mask=None) -> DataFrame:
    """The first n masked members of each group, by id."""
    mask = F.lit(True) if mask is None else mask
    rows = df.withColumn("__in", (mask & (F.col("group_id") >= 0)))
    out = ranked(rows, ["group_id", "__in"], "agent_id", "__rank")
    return update(out, acc, F.lit(float(value)), F.col("__in") & (F.col("__rank") <= n)).drop("__in", "__rank")


# --- lookup tables ----------------------------------------------------------------------------

def truncated(key: str) -> Column:
    """Integer key; null (no match) for NaN and infinities."""
    k = F.col(key).cast("double")
    return F.when(num.finite(k), k).otherwise(F.lit(None)).try_cast("long")


def data_lookup(df: DataFrame, acc: str, lookup: DataFrame, row_key: str, col_key: str | None = None, mask=None) -> DataFrame:
    """Value of lookup(row[, col], value) at the truncated keys, 0 out of range."""
    keys = ["__row"] + (["__col"] if col_key else [])
    rows = df.withColumn("__row", truncated(row_key))
    table = lookup.withColumnRenamed("row", "__row")
    if col_key:
        rows, table = rows.withColumn("__col", truncated(col_key)), table.withColumnRenamed("col", "__col")
    out = rows.join(table.select(*keys, F.col("value").alias("__hit")), keys, "left")
    return update(out, acc, F.coalesce("__hit", F.lit(0.0)), mask).drop("__hit", *keys)


# --- ordered lists of updaters ------------------------------------------------------------------

CUT_EVERY = 50   # writes between lineage cuts; keeps collapsed projections small


def apply_updaters(df: DataFrame, specs, t: int = 0, mask: Column | None = None, layers: DataFrame | None = None) -> DataFrame:
    """Apply updater dicts in order; each sees the writes before it.

    A spec has function, accumulator, and optionally parameters, spatial_data, source_trait,
    stratified_traits with trait_sizes and trait_combinations. Unknown names warn and are skipped.
    """
    mask = F.lit(True) if mask is None else mask
    layer_names = set(layers.columns) - {"cell_id"} if layers is not None else set()
    used = {s.get("spatial_data") for s in specs} & layer_names
    out = df.withColumn("__on", mask)
    if used:      # one join brings every layer the list reads
        wanted = sorted(used)
        out = out.join(layers.select(F.col("cell_id").alias("cell"), F.lit(True).alias("__hit"),
                                     *[F.col(n).alias(f"__l_{n}") for n in wanted]), "cell", "left")
    for i, spec in enumerate(specs):
        value = _spec_value(spec, out.columns, df.columns, t, layer_names)
        if value is None:
            continue
        on = F.col("__on")
        if spec.get("stratified_traits"):
            on = on & combo_mask(df.columns, spec["stratified_traits"], spec["trait_sizes"], spec["trait_combinations"])
        out = update(out, spec["accumulator"], value, on)
        if i and i % CUT_EVERY == 0:
            out = cut(out)
    return out.select(*df.columns)


def _spec_value(spec, columns, own, t, layer_names):
    fn, acc, params = spec.get("function", ""), spec.get("accumulator", ""), spec.get("parameters", [])
    if not acc:
        return None
    if acc not in own:
        log.warning("updater %r names unknown accumulator %r", fn, acc)
        return None
    lo, hi = num.bounds_of(*spec.get("bounds", (None, None)))
    if fn == "Clear":
        return clear(lo)
    if fn == "Increment":
        return increment(acc, float(params[0]) if params else 1.0, lo, hi)
    if fn == "TimeStep":
        return time_step(t, int(float(params[0])) if params else 0)
    if fn == "Expression":
        return expression(params[0], lo, hi) if params else None
    if fn == "TraitId":
        return trait_index(spec["source_trait"]) if spec.get("source_trait") else None
    if fn in ("IndividualLocations", "QuantifyLocation", "ExploredRunningSum"):
        name = spec.get("spatial_data")
        if name in layer_names:
            return F.coalesce(F.col(f"__l_{name}"), F.lit(0.0))
        return individual_location() if fn == "IndividualLocations" else None
    log.warning("unknown updater %r for accumulator %r", fn, acc)
    return None
