"""Complex survey designs: strata, PSUs, weights, linearised and replicate variances, weighted models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions.draws import pick
from sparkaudit.operators.ordered import null_safe_join, prefix_sums
from sparkaudit.operators.selection import exact_quantiles


def design_key(period: str, *parts: str) -> Column:
    """Strata or PSU labels prefixed by the period, for pooled periods."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in (period, *parts)])


def design_summary(df: DataFrame, strata: str, psu: str, keys: Sequence[str] = ()) -> DataFrame:
    """Strata, PSUs, degrees of freedom sum(m_h - 1), and strata with one PSU."""
    per = df.select(*keys, strata, psu).distinct().groupBy(*keys, strata).agg(F.count("*").alias("m"))
    return per.groupBy(*keys).agg(
        F.count("*").alias("n_strata"), F.sum("m").alias("n_psu"), F.sum(F.col("m") - 1).alias("degf"),
        F.count_if(F.col("m") == 1).alias("lonely"),
    )


def psu_totals(df: DataFrame, keys: Sequence[str], strata: str, psu: str, totals: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys, strata, psu).agg(*[F.sum(c).alias(k) for k, c in totals.items()])


def strata_variance(z: DataFrame, keys: Sequence[str], strata: str, value: str) -> DataFrame:
    """Sum over strata of m/(m-1) * sum (z - mean z)^2; ``z`` has one row per PSU. A lonely PSU adds nothing."""
    per = z.groupBy(*keys, strata).agg(F.count("*").alias("m"), F.var_samp(value).alias("v"))
    return per.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("m") * F.col("v")), F.lit(0.0)).alias("var"), F.sum(F.col("m") - 1).alias("degf"),
        F.count_if(F.col("m") == 1).alias("lonely"))


def svy_mean(df: DataFrame, y: Column, strata: str, psu: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean or proportion with the linearised with-replacement PSU variance.

    Rows collapse to PSU totals in the first pass; everything after that has one row per PSU.
    """
    w = F.col(weight)
    ok = y.isNotNull() & (w > 0)
    t = psu_totals(df.where(ok), keys, strata, psu, {"sw": w, "swy": w * y})
    whole = t.groupBy(*keys).agg((F.sum("swy") / F.sum("sw")).alias("mean"), F.sum("sw").alias("_w"))
    if keys:
        j = null_safe_join(t, whole, keys)
    else:
        j = t.withColumn("_h", whole.select(F.struct("mean", "_w")).scalar()).select(*t.columns, "_h.mean", "_h._w")
    z = j.withColumn("z", (F.col("swy") - F.col("mean") * F.col("sw")) / F.col("_w"))
    var = strata_variance(z, keys, strata, "z")
    means = whole.select(*keys, "mean")
    if keys:
        out = null_safe_join(means, var, keys)
    else:
        out = means.withColumn("_one", F.lit(1)).join(var.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out.select(*keys, "mean", F.sqrt("var").alias("se"), "degf", "lonely")


def rao_wu_weights(df: DataFrame, strata: str, psu: str, reps: int, seed: int = 1) -> DataFrame:
    """(strata, psu, rep, factor): m-1 PSUs drawn per stratum, times m/(m-1). A lonely PSU keeps factor 1."""
    psus = df.select(strata, psu).distinct()
    numbered = prefix_sums(psus, [strata], psu, {"one": F.lit(1).cast("bigint")}).select(
        strata, psu, (F.col("one_before") + 1).alias("_i"), F.col("one_total").alias("_m"))
    rep = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    drawn = numbered.where(F.col("_i") < F.col("_m")).select(strata, "_i", "_m", rep).select(
        strata, "rep", pick(F.col("_m"), seed, F.col("rep"), F.col(strata), F.col("_i")).alias("_i"))
    hits = drawn.groupBy(strata, "rep", "_i").agg(F.count("*").alias("times"))
    factor = F.col("times") * F.col("_m") / (F.col("_m") - 1)
    many = hits.join(numbered, [strata, "_i"]).select(strata, psu, "rep", factor.alias("factor"))
    lonely = numbered.where(F.col("_m") == 1).select(strata, psu, rep).withColumn("factor", F.lit(1.0))
    return many.unionByName(lonely)


def replicate_mean(df: DataFrame, y: Column, strata: str, psu: str, weight: str, factors: DataFrame) -> DataFrame:
    """Weighted mean of each replicate; only PSU totals meet the replicate table."""
    t = psu_totals(df, [], strata, psu, {"sw": F.col(weight), "swy": F.col(weight) * y})
    j = factors.join(t, [strata, psu])
    return j.groupBy("rep").agg((F.sum(F.col("factor") * F.col("swy")) / F.sum(F.col("factor") * F.col("sw"))).alias("mean"))


def effective_size(weight: str) -> Column:
    """(sum w)^2 / sum w^2."""
    return F.pow(F.sum(weight), F.lit(2.0)) / F.sum(F.col(weight) * F.col(weight))


# --- models ---------------------------------------------------------------------------------


def fit_logit(df: DataFrame, y: str, xs: Sequence[str], weight: str | None = None, max_iter: int = 50):
    """Weighted logistic regression by MLlib; weights are scaled to mean 1 first."""
    data = VectorAssembler(inputCols=list(xs), outputCol="_x", handleInvalid="skip").transform(df)
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol=y, maxIter=max_iter,
                                      tol=1e-10, regParam=0.0, predictionCol="p_hat")
    if weight:
        glr = glr.setWeightCol(weight)
    return glr.fit(data), data


def svy_logit(df: DataFrame, y: str, xs: Sequence[str], strata: str, psu: str, weight: str) -> dict[str, np.ndarray | int]:
    """Coefficients and the design-based sandwich covariance of a weighted logistic model.

    MLlib fits. One pass then sums the information matrix; one pass sums scores to PSUs and strata.
    The driver only inverts the p x p matrix.
    """
    mean_w = df.agg(F.avg(weight)).first()[0]
    data0 = df.withColumn("_w", F.col(weight) / F.lit(mean_w))
    model, data = fit_logit(data0, y, xs, "_w")
    names = ["intercept", *xs]
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    scored = model.transform(data)
    p = F.col("p_hat")
    info = scored.agg(*[F.sum(F.col("_w") * p * (1 - p) * cols[i] * cols[j]).alias(f"h{i}_{j}")
                        for i in range(len(cols)) for j in range(i, len(cols))]).first()
    size = len(cols)
    h = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            h[i, j] = h[j, i] = info[f"h{i}_{j}"]
    score = F.col("_w") * (F.col(y) - p)
    t = scored.groupBy(strata, psu).agg(*[F.sum(score * c).alias(f"u{i}") for i, c in enumerate(cols)])
    per = t.groupBy(strata).agg(
        F.count("*").alias("m"),
        *[F.covar_samp(f"u{i}", f"u{j}").alias(f"c{i}_{j}") for i in range(size) for j in range(i, size)])
    tot = per.agg(
        F.sum(F.col("m") - 1).alias("degf"),
        *[F.sum(F.when(F.col("m") > 1, F.col("m") * F.col(f"c{i}_{j}"))).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]).first()
    g = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            g[i, j] = g[j, i] = tot[f"g{i}_{j}"] or 0.0
    inv = np.linalg.inv(h)
    beta = np.array([model.intercept, *model.coefficients.toArray()])
    return {"names": names, "beta": beta, "cov": inv @ g @ inv, "degf": int(tot["degf"])}


def coefficient_table(spark, fit: dict) -> DataFrame:
    """term, estimate, SE, odds ratio and its interval exp(b +- t*se) with the design df."""
    from sparkaudit.functions.tails import t_quantile

    crit = float(t_quantile(0.975, np.array([fit["degf"]], float))[0])
    rows = []
    for name, b, v in zip(fit["names"], fit["beta"], np.diag(fit["cov"])):
        se = float(np.sqrt(v))
        rows.append((name, float(b), se, float(np.exp(b)), float(np.exp(b - crit * se)), float(np.exp(b + crit * se)), fit["degf"]))
    return spark.createDataFrame(rows, "term string, b double, se double, odds_ratio double, lo double, hi double, degf bigint")


def period_contrast(fit: dict, main: str, interaction: str) -> tuple[tuple[float, float], tuple[float, float]]:
    """(b, se) in the reference period and in the other one: b + b_int, V11 + Vkk + 2 V1k."""
    i, k = fit["names"].index(main), fit["names"].index(interaction)
    b, v = fit["beta"], fit["cov"]
    return (b[i], float(np.sqrt(v[i, i]))), (b[i] + b[k], float(np.sqrt(v[i, i] + v[k, k] + 2 * v[i, k])))


def ipw(df: DataFrame, included: str, xs: Sequence[str], weight: str) -> DataFrame:
    """Add p_hat = P(included | xs) and, for included rows, ``w`` = weight / p_hat scaled to mean 1. Not truncated."""
    model, data = fit_logit(df, included, xs)
    scored = model.transform(data).drop("_x")
    raw = F.when(F.col(included) == 1, F.col(weight) / F.col("p_hat"))
    scored = scored.withColumn("_raw", raw)
    return scored.withColumn("w", F.col("_raw") / scored.agg(F.avg("_raw")).scalar()).drop("_raw")


def ipw_report(scored: DataFrame, included: str, keys: Sequence[str] = ()) -> DataFrame:
    """p range, effective size, the identity mean(p_hat) = inclusion rate, and the three n's."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n_model"), F.sum(F.col(included)).cast("bigint").alias("n_analysis"), F.count("w").alias("n_weighted"),
        F.min("p_hat").alias("p_min"), F.max("p_hat").alias("p_max"), effective_size("w").alias("ess"),
        F.avg("p_hat").alias("mean_p"), F.avg(F.col(included).cast("double")).alias("rate"))


def nested_lr(df: DataFrame, y: str, small: Sequence[str], big: Sequence[str], weight: str | None = None) -> dict[str, float | bool]:
    """Deviance difference of nested logistic models. With weights it is not design-based, and says so."""
    m0, _ = fit_logit(df, y, small, weight) if small else (None, None)
    m1, _ = fit_logit(df, y, big, weight)
    d0 = m0.summary.deviance if m0 else m1.summary.nullDeviance
    return {"chi2": d0 - m1.summary.deviance, "df": len(big) - len(small), "design_based": weight is None}


def rcs_knots(df: DataFrame, x: str, shares: Sequence[float]) -> Column:
    """Knots at exact quantiles, as one array from a scalar subquery."""
    knots = exact_quantiles(df, [], F.col(x), shares).agg(F.array_sort(F.collect_list(F.struct("share", "quantile"))).alias("k"))
    return knots.select(F.col("k")["quantile"]).scalar()


def rcs_basis(df: DataFrame, x: str, shares: Sequence[float]) -> DataFrame:
    """Restricted cubic spline basis: x itself and k-2 terms, scaled by (last - first)^2."""
    k = len(shares)
    d = df.withColumn("_k", rcs_knots(df, x, shares))
    t = [F.get("_k", i) for i in range(k)]
    plus = lambda knot: F.pow(F.greatest(F.col(x) - knot, F.lit(0.0)), F.lit(3.0))
    scale = F.pow(t[-1] - t[0], F.lit(2.0))
    gap = t[-1] - t[-2]
    terms = []
    for i in range(k - 2):
        term = plus(t[i]) - plus(t[-2]) * (t[-1] - t[i]) / gap + plus(t[-1]) * (t[-2] - t[i]) / gap
        terms.append((term / scale).alias(f"{x}_s{i + 1}"))
    return d.select(*df.columns, *terms)


def rcs_report(shares: Sequence[float]) -> dict[str, int]:
    """Numbers that must agree in a report: knots, basis columns, non-linear degrees of freedom."""
    return {"knots": len(shares), "basis": len(shares) - 1, "nonlinear_df": len(shares) - 2}


def r2_vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """R2 of each column on the others, and its VIF, from one pass of correlations.

    The driver inverts a p x p matrix.
    """
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna().agg(
        *[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(cols))
    for i, j in pairs:
        r[i, j] = r[j, i] = row[f"r{i}_{j}"]
    vif = np.diag(np.linalg.inv(r))
    rows = [(c, float(1 - 1 / v), float(v)) for c, v in zip(cols, vif)]
    return df.sparkSession.createDataFrame(rows, "column string, r2 double, vif double")
