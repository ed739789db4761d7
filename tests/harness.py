"""Tools of the tests: order invariance of an operator, and simulated against analytic variance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import stats as S
from sparkaudit.functions.draws import normal
from sparkaudit.session import evaluate_once


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a result: rows, and a sum of row hashes (doubles at ten significant digits).

    Doubles are scaled by pi before they are cut, so that round values do not sit on a rounding edge.
    """
    cols: list[Column] = []
    for name, kind in df.dtypes:
        cols.append(F.format_string("%.9e", F.col(name) * math.pi) if kind in ("double", "float") else F.col(name))
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    return df.select(h.alias("_h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("_h"), F.lit(0)).alias("digest"))


def order_invariant(op, df: DataFrame, seed: int = 1) -> bool:
    """Does ``op`` give the same result on the rows as they are, shuffled, and repeated?

    Only three digests reach the driver.
    """
    plain = fingerprint(op(df)).first()
    shuffled = fingerprint(op(df.repartition(7, F.xxhash64(F.lit(seed), *df.columns)))).first()
    again = fingerprint(op(df)).first()
    return plain == shuffled == again


def mc_variance(reps: DataFrame, rep: str, grid: Sequence[tuple[int, int, float]], seed: int = 1) -> DataFrame:
    """Simulated against analytic variance of the SMD on a small grid of (n1, n0, delta).

    ``reps`` supplies the replicate ids; draws depend on (seed, grid cell, replicate, unit) only.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(a).alias("n1"), F.lit(b).alias("n0"), F.lit(float(d)).alias("delta"))
                      for i, (a, b, d) in enumerate(grid)])
    g = reps.select(F.col(rep).alias("rep"), F.inline(cells))

    def arm(n: Column, tag: str, shift: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: normal(seed, F.col("cell"), F.col("rep"), F.lit(tag), i) + shift)

    drawn = evaluate_once(g, _a=arm(F.col("n1"), "a", F.col("delta")), _b=arm(F.col("n0"), "b", F.lit(0.0)))
    mean = lambda c, n: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x) / n
    drawn = evaluate_once(drawn, m1=mean(F.col("_a"), F.col("n1")), m0=mean(F.col("_b"), F.col("n0")))
    sd = lambda c, m, n: F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / (n - 1))
    drawn = evaluate_once(
        drawn, s1=sd(F.col("_a"), F.col("m1"), F.col("n1")), s0=sd(F.col("_b"), F.col("m0"), F.col("n0"))
    )
    y, v = S.smd_rms(*[F.col(c) for c in ("m1", "s1", "n1", "m0", "s0", "n0")])
    e = drawn.select("cell", "n1", "n0", "delta", y.alias("y"), v.alias("v"))
    covered = F.abs(F.col("y") - F.col("delta")) <= S.Z95 * F.sqrt("v")
    out = e.groupBy("cell", "n1", "n0", "delta").agg(
        F.count("*").alias("reps"), F.avg("y").alias("mean_estimate"), F.var_samp("y").alias("empirical_variance"),
        F.avg("v").alias("analytic_variance"), F.avg(covered.cast("double")).alias("coverage"),
    )
    return out.withColumn("ratio", F.try_divide(F.col("analytic_variance"), F.col("empirical_variance")))
