"""Keyed uniforms: a draw depends on its key, never on partitioning or row order.

Every random choice in the library is a pure function of (seed, stream, key columns), so a
re-run, a lost executor or a different partition count gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Key = str | Column | Sequence[str | Column]    # what a draw depends on: ("agent_id", "time") draws anew at every step


def hash_u(seed: int, stream: str, *keys) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5(seed:stream:key:...); a key may be a sequence of columns."""
    keys = [k for key in keys for k in (key if isinstance(key, (list, tuple)) else [key])]
    parts = [F.lit(str(seed)), F.lit(stream)]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw(df: DataFrame, name: str, seed: int, stream: str, *keys) -> DataFrame:
    """Add the uniform as a column, so that expressions which read it often hash once per row."""
    return df.withColumn(name, hash_u(seed, stream, *keys))


def normal(seed: int, stream: str, *keys) -> Column:
    """Standard normal by Box-Muller on two streams; 1-u keeps the log finite."""
    u1 = hash_u(seed, stream + ".r", *keys)
    u2 = hash_u(seed, stream + ".a", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def poisson_terms(mean: float) -> tuple[int, list[float]]:
    """First count and cumulative probabilities from there on: all counts within ten deviations of the mean.

    Terms are taken in logs, so a large mean neither underflows nor runs out of terms.
    """
    if mean <= 0:
        return 0, [1.0]
    reach = 10 * math.sqrt(mean) + 20
    first = max(0, math.floor(mean - reach))
    total, out = 0.0, []
    for k in range(first, math.ceil(mean + reach) + 1):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        if k > mean and total >= 1.0 - 2.0 ** -33:
            break
    return first, out


def poisson_cdf(mean: float) -> list[float]:
    """Cumulative Poisson terms from count 0, for means small enough that counts start there."""
    first, out = poisson_terms(mean)
    return [0.0] * first + out


def poisson(u: Column, mean: float) -> Column:
    """Inverse-CDF Poisson: how many cumulative terms are <= u."""
    first, terms = poisson_terms(mean)
    return (F.lit(first) + count_le(u, terms)).cast("int")


def count_le(u: Column, bounds) -> Column:
    """Number of bounds <= u. Short lists stay plain conditions, which compile; long ones use an array.

    u is read once per bound, so pass a column that already holds the draw (see draw).
    """
    bounds = [float(b) for b in bounds]
    if len(bounds) <= 16:
        total = F.lit(0)
        for b in bounds:
            total = total + F.when(u >= F.lit(b), 1).otherwise(0)
        return total
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= u))


def count_le_row(u: Column, table, row: Column) -> Column:
    """Number of bounds <= u in one row of a literal table, column by column; null off the table."""
    width = len(table[0])
    total = F.lit(0)
    for k in range(width):
        bound = F.get(F.array(*[F.lit(float(r[k])) for r in table]), row)
        total = total + F.when(u >= bound, 1).when(bound.isNotNull(), 0)
    return total


def cumulative(probs) -> list[float]:
    out, total = [], 0.0
    for p in probs:
        total += float(p)
        out.append(total)
    return out


def categorical(u: Column, probs) -> Column:
    """Index of the drawn category; the last one takes any rounding remainder."""
    return count_le(u, cumulative(probs)[:-1]).cast("int")
