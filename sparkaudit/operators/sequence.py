"""Numbering, order and runs over position relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.operators.ordered import null_safe_join, prefix_sums, previous_row


def first_mention_order(df: DataFrame, keys: Sequence[str], num: str, pos: str) -> DataFrame:
    """(keys, num, first_pos, rank): distinct numbers ranked by their first position.

    ``pos`` is a whole number that is unique within keys.
    """
    first = df.groupBy(*keys, num).agg(F.min(pos).alias("first_pos"))
    ranked = prefix_sums(first, keys, "first_pos", {"one": F.lit(1).cast("bigint")})
    return null_safe_join(first, ranked.select(*keys, "first_pos", (F.col("one_before") + 1).alias("rank")), [*keys, "first_pos"])


def order_violations(df: DataFrame, keys: Sequence[str], num: str, pos: str) -> DataFrame:
    """Descents in first-appearance order: (keys, first_pos, prev, num)."""
    first = df.groupBy(*keys, num).agg(F.min(pos).alias("first_pos"))
    steps = previous_row(first, keys, "first_pos", [num])
    return steps.where(F.col(f"prev_{num}") > F.col(num))


def renumber_map(df: DataFrame, keys: Sequence[str], num: str, pos: str) -> DataFrame:
    """old -> new by first mention."""
    ranked = first_mention_order(df, keys, num, pos)
    return ranked.select(*keys, F.col(num).alias("old"), F.col("rank").alias("new"))


def sequence_audit(df: DataFrame, keys: Sequence[str], num: str) -> DataFrame:
    """Per key: rows, distinct numbers, highest, duplicated numbers, missing numbers, and is it 1..N."""
    counts = df.groupBy(*keys, num).agg(F.count("*").alias("_n"))
    out = counts.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.min(num).alias("lowest"),
        F.max(num).alias("highest"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated"),
        F.count_if((F.col(num) >= 1)).alias("_in"),
    )
    return (
        out.withColumn("n_missing", F.greatest(F.col("highest"), F.lit(0)) - F.col("_in"))
        .withColumn(
            "sequential",
            (F.col("n_missing") == 0) & (F.col("n_duplicated") == 0) & (F.col("lowest") == 1),
        )
        .drop("_in")
    )


def gaps(df: DataFrame, keys: Sequence[str], num: str) -> DataFrame:
    """Missing numbers between 1 and the highest, as ranges (from, to)."""
    distinct = df.select(*keys, F.col(num).cast("bigint").alias("_x")).distinct()
    steps = previous_row(distinct, keys, "_x", ["_x"])
    before = F.coalesce("prev__x", F.lit(0))
    return steps.where(F.col("_x") - before > 1).select(
        *keys, (before + 1).alias("gap_from"), (F.col("_x") - 1).alias("gap_to")
    )


def islands(df: DataFrame, keys: Sequence[str], num: str) -> DataFrame:
    """Maximal runs of consecutive whole numbers: (keys, first, last, length)."""
    one = {"one": F.lit(1).cast("bigint")}
    distinct = df.select(*keys, F.col(num).cast("bigint").alias("_x")).distinct()
    ranked = prefix_sums(distinct, keys, "_x", one)
    return (
        ranked.groupBy(*keys, (F.col("_x") - F.col("one_before")).alias("_g"))
        .agg(F.min("_x").alias("first"), F.max("_x").alias("last"), F.count("*").alias("length"))
        .drop("_g")
    )


def trailing_run(df: DataFrame, keys: Sequence[str], num: str, pos: str) -> DataFrame:
    """Rows of the final ascending run: everything from the last descent on."""
    steps = previous_row(df, keys, pos, [num])
    start = steps.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col(f"prev_{num}") > F.col(num), F.col(pos))), F.min(pos)).alias("_start")
    )
    return null_safe_join(df, start, keys).where(F.col(pos) >= F.col("_start")).drop("_start")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key. Spark cuts each partition to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest_revision(df: DataFrame, keys: Sequence[str], version: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Newest version of each document and how many older ones exist; map-side combined, no sort."""
    packed = F.struct(*version, *values)
    newest = df.groupBy(*keys).agg(F.max(packed).alias("_m"), (F.count("*") - 1).alias("n_older"))
    return newest.select(*keys, "_m.*", "n_older")


def fit_within_budget(df: DataFrame, keys: Sequence[str], value: str, tie: str, cost: Column, limit: int) -> DataFrame:
    """Entries by falling value until the budget is used: the prefix whose running cost fits.

    ``value`` is a whole number. The running sum goes over (value, tie) in two steps: distinct
    values first, then the entries of equal value.
    """
    rows = df.withColumn("cost", cost).withColumn("_neg", -F.col(value).cast("bigint"))
    by_value = prefix_sums(rows, keys, "_neg", {"cost": F.col("cost")})
    # A value whose earlier cost already passes the limit cannot contribute any row.
    open_values = by_value.where(F.col("cost_before") <= limit).select(*keys, "_neg", "cost_before")
    joined = null_safe_join(rows, open_values, [*keys, "_neg"])
    w = Window.partitionBy(*keys, "_neg").orderBy(tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        joined.withColumn("used", F.col("cost_before") + F.sum("cost").over(w))
        .where(F.col("used") <= limit)
        .drop("cost_before", "_neg")
    )


def round_to_total(df: DataFrame, keys: Sequence[str], value: str, tie: str, total: float, dp: int = 1) -> DataFrame:
    """Rounded parts that sum to ``total``: floor, then the largest remainders get one unit.

    The number of units to hand out is less than the number of parts of the key.
    """
    unit = 10**dp
    # Remainders are kept as whole numbers of 1e-6 units, so order and ties are exact.
    scaled = F.round(F.col(value) * unit, 6)
    rows = df.withColumn("_floor", F.floor(scaled).cast("bigint")).withColumn(
        "_rest", -F.round((scaled - F.floor(scaled)) * 1000000).cast("bigint")
    )
    sums = prefix_sums(rows, keys, "_rest", {"n": F.lit(1).cast("bigint"), "f": F.col("_floor")})
    deficit = F.lit(int(round(total * unit))) - F.col("f_total")
    sums = sums.select(*keys, "_rest", "n_before", deficit.alias("_deficit"))
    joined = null_safe_join(rows, sums, [*keys, "_rest"])
    place = F.col("n_before") + F.row_number().over(Window.partitionBy(*keys, "_rest").orderBy(tie))
    up = F.when(place <= F.col("_deficit"), 1).otherwise(0)
    return joined.withColumn("rounded", (F.col("_floor") + up) / unit).drop("_floor", "_rest", "n_before", "_deficit")


def quantile_groups(df: DataFrame, keys: Sequence[str], value: str, q: int) -> DataFrame:
    """Add ``group`` 1..q by rank; equal values share a group."""
    sums = prefix_sums(df, keys, value, {"n": F.lit(1).cast("bigint")})
    group = (F.floor(F.col("n_before") * q / F.col("n_total")) + 1).cast("bigint")
    return null_safe_join(df, sums.select(*keys, value, group.alias("group")), [*keys, value])


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with (rank - 1) / (n - 1)."""
    sums = prefix_sums(df, keys, value, {"n": F.lit(1).cast("bigint")})
    share = F.when(F.col("n_total") > 1, F.col("n_before") / (F.col("n_total") - 1)).otherwise(F.lit(0.0))
    return sums.select(*keys, value, "n", share.alias("percent_rank"))


