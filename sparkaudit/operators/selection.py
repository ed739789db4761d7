"""Exact quantiles of groups of any size: radix histograms over the order-preserving bits of a double, narrowed over passes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkaudit.operators.ordered import null_safe_join
from sparkaudit.session import cut_lineage

DIGIT = 16
REST = np.int64(2**63 - 1)


@F.pandas_udf(T.LongType())
def _to_ordered(value: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles; -0.0 is 0.0."""
    bits = (value.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & REST))


@F.pandas_udf(T.DoubleType())
def _from_ordered(value: pd.Series) -> pd.Series:
    bits = value.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> 63) & REST)).view(np.float64))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """(keys, share, quantile), interpolated between neighbours like SQL's continuous percentile.

    A pass counts the values of each group by their next 16 bits, and only those in the cells that hold a wanted rank go on
    to the next: four passes, and no task or window holds more than 65,536 counts of a group, whatever its size or its
    number of different values. NULL values are left out, a group without any has no row; NULL keys are a group.
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL").select(*keys, _to_ordered("_v").alias("_b"))
    wanted = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        if wanted is None:
            inside = rows.withColumn("_in", F.lit(0).cast("bigint"))
        else:
            cells = wanted.select(*keys, "_in").distinct()
            inside = null_safe_join(rows.withColumn("_in", F.shiftright("_b", shift + DIGIT)), cells, [*keys, "_in"])
        counts = inside.groupBy(*keys, "_in", F.shiftright("_b", shift).alias("_cell")).agg(F.count("*").alias("_n"))
        order = Window.partitionBy(*keys, "_in").orderBy("_cell")
        counts = counts.withColumn("_upto", F.sum("_n").over(order))
        if wanted is None:
            counts = cut_lineage(counts)  # read twice
            wanted = _ranks(counts, keys, shares)
        met = null_safe_join(wanted, counts, [*keys, "_in"]).where("_rank < _upto AND _rank >= _upto - _n")
        wanted = cut_lineage(met.select(*keys, "share", "_far", "_upper", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), F.col("_cell").alias("_in")))
    ends = wanted.select(*keys, "share", "_far", "_upper", _from_ordered("_in").alias("_v"))
    low, high = F.max(F.when(~F.col("_upper"), F.col("_v"))), F.max(F.when(F.col("_upper"), F.col("_v")))
    far = F.max("_far")
    between = F.when(low == high, low).otherwise((1 - far) * low + far * high)
    return ends.groupBy(*keys, "share").agg(between.alias("quantile"))


def _ranks(counts: DataFrame, keys: list[str], shares: Sequence[float]) -> DataFrame:
    """The two neighbours of each share's place among the values of a group."""
    sizes = counts.groupBy(*keys).agg(F.max("_upto").alias("_all"))
    placed = sizes.select(*keys, "_all", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("_at", (F.col("_all") - 1) * F.col("share"))
    below = F.floor("_at")
    return placed.select(*keys, "share", (F.col("_at") - below).alias("_far"), F.lit(0).cast("bigint").alias("_in"), F.inline(F.array(
        F.struct(F.lit(False).alias("_upper"), below.alias("_rank")), F.struct(F.lit(True).alias("_upper"), F.ceil("_at").alias("_rank")))))
