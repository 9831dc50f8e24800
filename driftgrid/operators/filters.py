"""Row predicates: activity masks, trait criteria, combination flags, step triggers."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.rand import hash_u
from driftgrid.plans.ordered import TICKS, nth_smallest

log = logging.getLogger(__name__)


def active_mask() -> Column:
    return F.col("alive") & ~F.col("arrived")


def active(df: DataFrame) -> DataFrame:
    return df.filter(active_mask())


def resolve_category(categories, value) -> int:
    """Category index of a label or an index."""
    if isinstance(value, str):
        if value not in categories:
            raise ValueError(f"unknown category {value!r}; known: {list(categories)}")
        return list(categories).index(value)
    return int(value)


def traits_mask(definitions: dict, **criteria) -> Column:
    """AND over traits, OR within a list; definitions = {trait: [labels]}."""
    mask = F.lit(True)
    for trait, wanted in criteria.items():
        if trait not in definitions:
            raise KeyError(f"unknown trait {trait!r}; known: {sorted(definitions)}")
        values = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        mask = mask & F.col(trait).isin([resolve_category(definitions[trait], v) for v in values])
    return mask


def filter_by_traits(df: DataFrame, definitions: dict, **criteria) -> DataFrame:
    return df.filter(traits_mask(definitions, **criteria))


def combo_mask(columns, traits, sizes, flags) -> Column:
    """True where the flag of the row's trait combination is 1 (last trait varies fastest).

    A missing trait or a flag list of the wrong length keeps every row, with a warning.
    """
    missing = [t for t in traits if t not in columns]
    total = 1
    for s in sizes:
        total *= s
    if missing or len(flags) != total:
        log.warning("combination filter ignored: missing traits %s, %d flags for %d combinations",
                    missing, len(flags), total)
        return F.lit(True)
    index, stride = F.lit(0), 1
    for trait, size in reversed(list(zip(traits, sizes))):
        index = index + F.col(trait).cast("int") * stride
        stride *= size
    return F.coalesce(F.get(F.array(*[F.lit(int(f)) for f in flags]), index) == 1, F.lit(False))


def filter_by_combo(df: DataFrame, traits, sizes, flags) -> DataFrame:
    return df.filter(combo_mask(df.columns, traits, sizes, flags))


def trigger_every() -> Column:
    return F.lit(True)


def trigger_once(t, at: int) -> Column:
    return F.col(t) == at


def trigger_once_external(t, timestep: int) -> Column:
    """External time steps count from one."""
    return trigger_once(t, timestep - 1)


def trigger_periodic(t, interval: int, offset: int = 0) -> Column:
    if interval <= 0:
        raise ValueError(f"interval must be positive, got {interval}")
    return (F.col(t) >= offset) & (F.pmod(F.col(t) - offset, F.lit(interval)) == 0)


def trigger_window(t, start: int, end: int) -> Column:
    return (F.col(t) >= start) & (F.col(t) < end)


def trigger_random(t, p: float, seed: int) -> Column:
    return hash_u(seed, "trigger", t) < p


def floaters(df: DataFrame) -> DataFrame:
    return df.filter(F.col("alive") & (F.col("group_id") == -1))


def grouped(df: DataFrame) -> DataFrame:
    return df.filter(F.col("alive") & (F.col("group_id") >= 0))


def valid_category_mask(col: str, allowed=(1, 2, 3)) -> Column:
    """Membership in an explicit set, so a -1 sentinel never passes."""
    return F.coalesce(F.col(col).isin(list(allowed)), F.lit(False))


def compact(df: DataFrame) -> DataFrame:
    return df.filter("alive")


def remove(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("agent_id"), "agent_id", "left_anti")


def cells_in_region(cells: DataFrame, names, name: str) -> DataFrame:
    """Cells of a named region; an unknown name gives no rows."""
    wanted = names.index(name) if name in names else None
    return cells.filter(F.lit(False) if wanted is None else F.col("region_id") == wanted)


def region_label(names) -> Column:
    """'Land' below zero, the name in range, else 'Unknown'."""
    r = F.col("region_id")
    arr = F.array(*[F.lit(n) for n in names])
    return F.when(r < 0, F.lit("Land")).otherwise(F.coalesce(F.get(arr, r), F.lit("Unknown")))


def subsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """All rows when there are at most n, else the n with the smallest keyed uniform.

    The n-th smallest draw is found first; taking the sample is then a plain filter.
    """
    drawn = df.withColumn("__tick", tick_of(hash_u(seed, "subsample", key)))
    cutoff = nth_smallest(drawn, "__tick", key, n)
    return (drawn if cutoff is None else drawn.filter(up_to("__tick", key, cutoff))).drop("__tick")


def tick_of(u: Column) -> Column:
    return (u * F.lit(float(TICKS))).cast("long")


def up_to(tick: str, tie: str, cutoff) -> Column:
    return F.struct(tick, tie) <= F.struct(F.lit(cutoff[0]).alias(tick), F.lit(cutoff[1]).alias(tie))
