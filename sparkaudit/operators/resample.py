"""Cluster bootstrap and optimism. Replicates multiply cluster totals, never data rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions.draws import pick, poisson1
from sparkaudit.operators.ordered import null_safe_join, prefix_sums


def replicate_weights(clusters: DataFrame, cluster: str, reps: int, seed: int = 1, method: str = "poisson",
                      strata: Sequence[str] = ()) -> DataFrame:
    """(strata, cluster, rep, times): how often each cluster enters each replicate.

    ``poisson`` draws each count on its own, without a shuffle. ``multinomial`` draws exactly as
    many clusters as there are, by dense number, and counts the hits.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    if method == "poisson":
        return clusters.select(*strata, cluster, rep).withColumn("times", poisson1(seed, F.col("rep"), F.col(cluster))).where(
            F.col("times") > 0)
    if method != "multinomial":
        raise ValueError(f"unknown method {method}")
    numbered = prefix_sums(clusters.select(*strata, cluster).distinct(), strata, cluster, {"one": F.lit(1).cast("bigint")})
    numbered = numbered.select(*strata, cluster, (F.col("one_before") + 1).alias("_i"), F.col("one_total").alias("_n"))
    draws = numbered.select(*strata, "_i", "_n", rep).select(
        *strata, "rep", pick(F.col("_n"), seed, F.col("rep"), *[F.col(s) for s in strata], F.col("_i")).alias("_i"))
    hits = draws.groupBy(*strata, "rep", "_i").agg(F.count("*").alias("times"))
    return null_safe_join(hits, numbered.select(*strata, "_i", cluster), [*strata, "_i"]).drop("_i")


def bootstrap(df: DataFrame, cluster: str, totals: Mapping[str, Column], stats: Mapping[str, Column], reps: int,
              seed: int = 1, method: str = "poisson") -> DataFrame:
    """(rep, stat columns): every statistic of a replicate uses the same resampled clusters.

    ``totals`` are summed per cluster once; ``stats`` are expressions over the weighted totals, so a
    paired difference is formed inside its replicate.
    """
    per = df.groupBy(cluster).agg(*[F.sum(c).alias(k) for k, c in totals.items()])
    w = replicate_weights(per.select(cluster), cluster, reps, seed, method)
    if method == "poisson":
        drawn = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn(
            "times", poisson1(seed, F.col("rep"), F.col(cluster)))
    else:
        drawn = w.join(per, cluster)
    sums = drawn.groupBy("rep").agg(*[F.sum(F.col(k) * F.col("times")).alias(k) for k in totals])
    return sums.select("rep", *[c.alias(k) for k, c in stats.items()])


def percentile_ci(reps: DataFrame, stats: Sequence[str], level: float = 0.95) -> DataFrame:
    """One row per statistic: mean of the replicates and the percentile interval. ``reps`` has one row per replicate."""
    a = (1 - level) / 2
    out = reps.agg(*[
        F.struct(F.avg(s).alias("mean"), F.stddev_samp(s).alias("se"), F.percentile(F.col(s), F.lit(a)).alias("lo"),
                 F.percentile(F.col(s), F.lit(1 - a)).alias("hi")).alias(s) for s in stats])
    rows = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"{s}.mean").alias("mean"), F.col(f"{s}.se").alias("se"),
                              F.col(f"{s}.lo").alias("lo"), F.col(f"{s}.hi").alias("hi")) for s in stats])
    return out.select(F.inline(rows))


def rate_model_replicates(df: DataFrame, cluster: str, group: str, outcome: str, reps: int, seed: int = 1) -> DataFrame:
    """Bootstrap of a group-rate model: Brier score of each refitted model in its replicate and on the original.

    Sufficient counts per (cluster, group) carry everything: n and events.
    """
    per = df.groupBy(cluster, group).agg(F.count("*").alias("n"), F.sum(outcome).alias("e"))
    original = per.groupBy(group).agg(F.sum("n").alias("n0"), F.sum("e").alias("e0"))
    drawn = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn(
        "t", poisson1(seed, F.col("rep"), F.col(cluster)))
    boot = drawn.groupBy("rep", group).agg(F.sum(F.col("n") * F.col("t")).alias("n"), F.sum(F.col("e") * F.col("t")).alias("e"))
    overall = boot.groupBy("rep").agg((F.sum("e") / F.sum("n")).alias("_p"))
    m = boot.join(original, group).join(overall, "rep")
    # A group that a replicate never drew predicts the replicate's overall rate.
    p = F.coalesce(F.try_divide(F.col("e"), F.col("n")), F.col("_p"))
    sq = lambda e, n: e * (1 - p) * (1 - p) + (n - e) * p * p
    return m.groupBy("rep").agg(
        (F.sum(sq(F.col("e"), F.col("n"))) / F.sum("n")).alias("boot_apparent"),
        (F.sum(sq(F.col("e0"), F.col("n0"))) / F.sum("n0")).alias("boot_on_original"),
    )


def optimism(apparent: DataFrame, reps: DataFrame) -> DataFrame:
    """apparent - mean(boot apparent - boot on original). ``apparent`` has one row and one column ``apparent``."""
    gap = F.avg(F.col("boot_apparent") - F.col("boot_on_original"))
    return reps.agg(F.count("*").alias("reps"), gap.alias("optimism")).withColumn("apparent", apparent.select("apparent").scalar()).withColumn(
        "corrected", F.col("apparent") - F.col("optimism"))
