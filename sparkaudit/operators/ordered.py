"""Ordered computations that stay parallel inside one large group.

A plain window puts a whole group into one task. The helpers here first cut every group into
order-preserving buckets of a bounded number of rows, work inside (group, bucket), and carry only
one small row per bucket across the group. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.session import cut_lineage


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``, monotone in ``order`` within a group.

    Buckets are the range partitions of (keys, order), so they are sized by rows, whatever the type, the spread or the
    common beginnings of the values, and a group of many rows has as many buckets as it needs. All groups together have
    ``buckets`` of them, by default ``spark.sql.shuffle.partitions``. They are written, so that every reader, and every
    task that is repeated, sees the same cuts.
    """
    parts = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *keys, *order)
    return cut_lineage(cut.withColumn("_bucket", F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Mapping[str, Column],
    buckets: int | None = None,
) -> DataFrame:
    """One row per (keys, order value) with, for each measure m, ``m``, ``m_before`` and ``m_total``.

    ``m_before`` sums the strictly smaller order values of the group. Ties collapse in the
    map-side combine before anything is ordered. NULL order values are left out.
    """
    keys = list(keys)
    grouped = (
        df.where(F.col(order).isNotNull())
        .groupBy(*keys, order)
        .agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    )
    grouped = ranged(grouped, keys, [order], buckets)
    by_bucket = grouped.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = by_bucket.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{m}").over(across), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = grouped.select(
        *keys,
        order,
        "_bucket",
        *measures,
        *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_l_{m}") for m in measures],
    )
    joined = null_safe_join(local, offsets, [*keys, "_bucket"])
    return joined.select(
        *keys,
        order,
        *measures,
        *[(F.col(f"_l_{m}") + F.col(f"_o_{m}")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where NULL keys meet each other, with one copy of the keys."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    condition = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, by: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct values with their count ``n``, average rank ``avg_rank`` and any extra measures."""
    measures = {"n": F.lit(1).cast("bigint"), **(by or {})}
    sums = prefix_sums(df, keys, value, measures)
    return sums.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    ties: Sequence[str] = (),
    prefix: str = "prev_",
) -> DataFrame:
    """Add the values of the row before, in (order, ties), within keys. Rows of one order value are split by their ties."""
    keys = list(keys)
    bucketed = ranged(df, keys, [order, *ties])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)
    packed = F.struct(*[F.col(v) for v in values])
    rows = bucketed.withColumn("_prev", F.lag(packed).over(inside))
    last = bucketed.groupBy(*keys, "_bucket").agg(F.max_by(packed, F.struct(order, *ties)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carry = last.select(*keys, "_bucket", F.lag("_last").over(across).alias("_carry"))
    joined = null_safe_join(rows, carry, [*keys, "_bucket"])
    prev = F.coalesce("_prev", "_carry")
    return joined.select(
        *[c for c in df.columns],
        *[prev.getField(v).alias(f"{prefix}{v}") for v in values],
    )


def suffix_min(df: DataFrame, keys: Sequence[str], order: str, value: str, buckets: int | None = None) -> DataFrame:
    """Add ``<value>_suffix``: the smallest value among rows of the group at or above the own order value.

    One row per (keys, order) is expected.
    """
    keys = list(keys)
    bucketed = ranged(df, keys, [order], buckets)
    lows = bucketed.groupBy(*keys, "_bucket").agg(F.min(value).alias("_low"))
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    later = lows.select(*keys, "_bucket", F.min("_low").over(across).alias("_later"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    local = bucketed.withColumn("_here", F.min(value).over(inside))
    joined = null_safe_join(local, later, [*keys, "_bucket"])
    return joined.select(*df.columns, F.least("_here", "_later").alias(f"{value}_suffix"))
