"""Closed-form statistics as Column expressions. Undefined results are NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL when a side is constant (the built-in raises in ANSI mode).

    Least and greatest value tell a constant: partial means put together in tasks leave it a deviation of some 1e-15.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def round_half_up(x: Column, dp: int = 0) -> Column:
    """Half away from zero, never banker's."""
    return F.round(x, dp)


def wilson(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of x/n; (0, 0) when n is 0."""
    x, n = x.cast("double"), n.cast("double")
    p = F.try_divide(x, n)
    denom = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / denom
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / denom
    empty = n == 0
    return (
        F.when(empty, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half)),
        F.when(empty, F.lit(0.0)).otherwise(F.least(F.lit(1.0), centre + half)),
    )


def common_increment(ratio: Column, sd: Column, increment: Column) -> Column:
    """An odds ratio per SD moved to another increment; the P value does not change."""
    return F.pow(ratio, F.try_divide(increment, sd))


def _e_value(v: Column) -> Column:
    up = F.when(v < 1, F.try_divide(F.lit(1.0), v)).otherwise(v)
    return up + F.sqrt(up * (up - 1))


def e_value(rr: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """E-value of the estimate and of the interval end nearest to 1 (1 when the interval crosses 1)."""
    crosses = (lo <= 1) & (hi >= 1)
    near = F.when(rr < 1, hi).otherwise(lo)
    return _e_value(rr), F.when(crosses, F.lit(1.0)).otherwise(_e_value(near))


def estimate_triangle(ratio: Column, lo: Column, hi: Column, p: Column, tol: float = 0.05, percentile: bool = False
                      ) -> Column:
    """Problems of an (estimate, interval, P) triple on the log scale.

    ``sides``: the two half widths differ by more than ``tol`` (not asked of percentile intervals);
    ``p_vs_ci``: the interval crosses 1 but P <= 0.05, or the reverse; ``order``: lo <= est <= hi fails.
    """
    left, right = F.ln(ratio) - F.ln(lo), F.ln(hi) - F.ln(ratio)
    crosses = (lo <= 1) & (hi >= 1)
    tests = {
        "order": ~((lo <= ratio) & (ratio <= hi)),
        "p_vs_ci": crosses != (p > 0.05),
    }
    if not percentile:
        tests["sides"] = F.abs(left - right) > tol * F.greatest(F.abs(left), F.abs(right))
    return F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()]), lambda x: x.isNotNull())


def ci_consistency(est: Column, lo: Column, hi: Column) -> Column:
    """Problems of an estimate on a difference scale: outside its interval, or of the other sign."""
    tests = {
        "outside": ~((lo <= est) & (est <= hi)),
        "sign": ((lo > 0) & (est < 0)) | ((hi < 0) & (est > 0)),
    }
    return F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()]), lambda x: x.isNotNull())


def small_sample_j(n1: Column, n0: Column) -> Column:
    """J = 1 - 3/(4(n1+n0)-2)."""
    return 1 - F.try_divide(F.lit(3.0), 4 * (n1 + n0) - 2)


def smd_rms(m1: Column, s1: Column, n1: Column, m0: Column, s0: Column, n0: Column) -> tuple[Column, Column]:
    """Standardised mean difference over the root-mean-square SD, and its variance."""
    n1, n0 = n1.cast("double"), n0.cast("double")
    y = small_sample_j(n1, n0) * F.try_divide(m1 - m0, F.sqrt((s1 * s1 + s0 * s0) / 2))
    v = F.try_divide((n1 + n0).cast("double"), (n1 * n0)) + F.try_divide(y * y, 2 * (n1 + n0))
    return y, F.when(y.isNotNull(), v)


def smd_pooled(m1: Column, s1: Column, n1: Column, m0: Column, s0: Column, n0: Column) -> tuple[Column, Column]:
    """Classic Hedges g over the pooled SD, J = 1 - 3/(4N-9)."""
    n1, n0 = n1.cast("double"), n0.cast("double")
    pooled = F.sqrt(F.try_divide((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0, n1 + n0 - 2))
    g = (1 - F.try_divide(F.lit(3.0), 4 * (n1 + n0) - 9)) * F.try_divide(m1 - m0, pooled)
    v = F.try_divide((n1 + n0).cast("double"), (n1 * n0)) + F.try_divide(g * g, 2 * (n1 + n0))
    return g, F.when(g.isNotNull(), v)


def smd_paired(m1: Column, s1: Column, m0: Column, s0: Column, n: Column, r: Column) -> tuple[Column, Column]:
    """Paired mean difference over the root-mean-square SD of the two arms; r is the within-pair correlation.

    With m = (s1^2 + s0^2)/2 the variance is
    (s1^2 + s0^2 - 2 r s1 s0) / (m (n-1)) + y^2 (s1^4 + s0^4 + 2 r^2 s1^2 s0^2) / (8 m^2 (n-1)).
    """
    mean_var = (s1 * s1 + s0 * s0) / 2
    j = 1 - F.try_divide(F.lit(3.0), 4 * (n - 1) - 1)
    y = j * F.try_divide(m1 - m0, F.sqrt(mean_var))
    diff_var = s1 * s1 + s0 * s0 - 2 * r * s1 * s0
    fourth = F.pow(s1, F.lit(4.0)) + F.pow(s0, F.lit(4.0)) + 2 * r * r * s1 * s1 * s0 * s0
    v = F.try_divide(diff_var, mean_var * (n - 1)) + F.try_divide(y * y * fourth, 8 * mean_var * mean_var * (n - 1))
    return y, F.when(y.isNotNull(), v)
