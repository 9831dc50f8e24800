"""Named table transforms and their composition; plain functions over DataFrame.transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.plans.lineage import cut, ship

STEPS: dict[str, Callable] = {}


def register(name: str):
    """Decorator: make a transform df -> df available by name."""
    def deco(fn):
        STEPS[name] = fn
        return fn
    return deco


def lookup(name: str) -> Callable:
    if name not in STEPS:
        raise KeyError(f"unknown step {name!r}; known: {sorted(STEPS)}")
    return STEPS[name]


def chain(df: DataFrame, steps) -> DataFrame:
    """Apply steps in order; a step is a name, (name, parameters) or a function."""
    for s in steps:
        if callable(s):
            df = df.transform(s)
        elif isinstance(s, str):
            df = df.transform(lookup(s))
        else:
            name, params = s
            df = df.transform(lambda d, f=lookup(name), p=params: f(d, **p))
    return df


def custom(df: DataFrame, fn: Callable, schema=None, by=None) -> DataFrame:
    """User callback: df -> df, or with a schema an Arrow batch function (per group when by is set)."""
    if schema is None:
        return df.transform(fn)
    ship(fn)
    return df.groupBy(*by).applyInPandas(fn, schema) if by else df.mapInPandas(fn, schema)


def repeat(df: DataFrame, steps, times: int, mask: Callable[[], Column] | None = None, cut_every: int = 5) -> DataFrame:
    """Apply a group of steps several times with the mask taken once per iteration.

    Steps read the column in_mask, so later members see the rows as they were when the iteration
    began, and the column iteration (from 0): a step with key ("agent_id", "iteration") draws anew each time.
    """
    cols = df.columns
    for i in range(times):
        df = df.withColumns({"in_mask": mask() if mask else F.lit(True), "iteration": F.lit(i)})
        df = chain(df, steps).select(*cols)
        if i % cut_every == cut_every - 1 and i + 1 < times:
            df = cut(df)
    return df
