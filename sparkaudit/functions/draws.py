"""Reproducible random numbers.

A draw is a function of its keys (seed, replicate, unit), so it does not depend on partitions, row
order or a lost executor, and any engine with MD5 repeats it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13
SPAN = float(16**DIGITS)


def uniform(*keys: Column | str | int) -> Column:
    """A number in (0, 1) from the MD5 of the keys."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / SPAN


def normal(*keys: Column | str | int) -> Column:
    """Box-Muller from two independent draws."""
    u, v = uniform(*keys, "u"), uniform(*keys, "v")
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def poisson1(*keys: Column | str | int) -> Column:
    """A Poisson(1) count by inversion, up to where the distribution function stops moving in double precision."""
    u = uniform(*keys)
    count, cumulative, k = F, 0.0, 0
    while (above := cumulative + math.exp(-1) / math.factorial(k)) > cumulative:
        count, cumulative, k = count.when(u < above, F.lit(k)), above, k + 1
    return count.otherwise(F.lit(k)).cast("bigint")


def pick(n: Column, *keys: Column | str | int) -> Column:
    """A whole number from 1 to n."""
    return F.least(F.floor(uniform(*keys) * n) + 1, n).cast("bigint")
