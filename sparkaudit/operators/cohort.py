"""Cleaning and derived columns of cohort tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit conversions to mg/dL and uU/mL, and the sex-specific waist offsets.
TG_FACTOR = 88.57
CHOLESTEROL_FACTOR = 38.67
INSULIN_DIVISOR = 6.945
HOMA_DIVISOR = 405.0
WAIST_OFFSET_MALE = 65.0
WAIST_OFFSET_FEMALE = 58.0


def clean_sentinels(
    df: DataFrame, sentinels: Mapping[str, Sequence[float]], ranges: Mapping[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Sentinel codes to NULL, then implausible values to NULL."""
    out = {}
    for name in df.columns:
        c = F.col(name)
        if name in sentinels:
            c = F.when(~F.col(name).isin(*sentinels[name]), c)
        if ranges and name in ranges:
            c = F.when(c.between(*ranges[name]), c)
        out[name] = c
    return df.select(*[c.alias(n) for n, c in out.items()])


def composite_indices(tg: Column, hdl: Column, ldl: Column, insulin: Column, glucose: Column, waist: Column, bmi: Column,
                      male: Column) -> dict[str, Column]:
    """Composite metabolic indices. Lipids in mmol/L, insulin in pmol/L, glucose in mg/dL."""
    tg_mg, hdl_mg, ldl_mg = tg * TG_FACTOR, hdl * CHOLESTEROL_FACTOR, ldl * CHOLESTEROL_FACTOR
    insulin_uu = insulin / INSULIN_DIVISOR
    return {
        "tg_mgdl": tg_mg,
        "hdl_mgdl": hdl_mg,
        "ldl_mgdl": ldl_mg,
        "insulin_uu": insulin_uu,
        "tyg": F.ln(glucose * tg_mg / 2),
        "homa_ir": insulin_uu * glucose / HOMA_DIVISOR,
        "lap": (waist - F.when(male, F.lit(WAIST_OFFSET_MALE)).otherwise(F.lit(WAIST_OFFSET_FEMALE))) * tg,
        "mets_ir": F.try_divide(F.ln((2 * glucose + tg_mg) * bmi), F.ln(hdl_mg)),
        "glm7_noage": F.log10(F.try_divide(bmi * glucose * insulin * tg * ldl, hdl)),
        "glm7_noage_nobmi": F.log10(F.try_divide(glucose * insulin * tg * ldl, hdl)),
    }


def per_sd(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns divided by their own SD inside the given sample, as ``<name>_sd``."""
    sds = df.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in columns])).scalar()
    scaled = df.withColumn("_sd", sds)
    return scaled.select(*df.columns, *[F.try_divide(F.col(c), F.col("_sd").getField(c)).alias(f"{c}_sd") for c in columns])


def branch_outcome(cases: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The outcome of the first branch whose selector holds."""
    chain = None
    for selector, value in cases:
        chain = F.when(selector, value) if chain is None else chain.when(selector, value)
    return chain.otherwise(default) if default is not None else chain


def branch_report(df: DataFrame, branch: Column, outcome: Column, age: Column) -> DataFrame:
    """Rows, filled outcomes and the age span per branch, so a missing branch is visible."""
    return df.groupBy(branch.alias("branch")).agg(
        F.count("*").alias("n"), F.count(outcome).alias("n_filled"), F.count_if(outcome == 1).alias("n_cases"),
        F.min(age).alias("min_age"), F.max(age).alias("max_age"),
    )


def detect_log_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values that look like raw counts (over 90 % whole numbers and a maximum over 50) need log2(x+1)."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(
        F.avg((v == F.floor(v)).cast("double")).alias("integer_share"), F.max(v).alias("max_value")
    )
    raw = (F.col("integer_share") > 0.90) & (F.col("max_value") > 50)
    return out.withColumn("scale", F.when(raw, "raw_counts").otherwise("already_log"))


def to_log_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Apply the rule per key; the scale table has one row per key."""
    scale = detect_log_scale(df, keys, value).select(*keys, "scale")
    logged = F.when(F.col("scale") == "raw_counts", F.log2(F.col(value) + 1)).otherwise(F.col(value))
    return df.join(scale, list(keys)).withColumn(f"{value}_log", logged).drop("scale")


def weight_scale(df: DataFrame, weight: str, scheme: str, layer: str | None = None) -> DataFrame:
    """``each_mean_1`` and ``equal_layer`` rescale within layers, ``raw`` keeps the weights."""
    if scheme == "raw":
        return df.withColumn("w", F.col(weight))
    if layer is None:
        raise ValueError("a layer column is needed")
    sums = df.groupBy(layer).agg(F.sum(weight).alias("_s"), F.count("*").alias("_n"))
    joined = df.join(sums, layer)
    if scheme == "each_mean_1":
        return joined.withColumn("w", F.col(weight) * F.col("_n") / F.col("_s")).drop("_s", "_n")
    if scheme == "equal_layer":
        return joined.withColumn("w", F.col(weight) / F.col("_s")).drop("_s", "_n")
    raise ValueError(f"unknown scheme {scheme}")
