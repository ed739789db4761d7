"""Tail probabilities of result rows.

Spark has no normal, t, F or chi-square distribution. These Arrow-batched functions run on
already aggregated rows (one per test), never on data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def _each(f, x: np.ndarray) -> np.ndarray:
    return np.array([f(v) for v in np.ravel(x)], dtype=float).reshape(np.shape(x))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return _each(math.lgamma, x)


def _erfc(x: np.ndarray) -> np.ndarray:
    return _each(math.erfc, x)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    out = np.full(x.shape, np.nan)
    out[x <= 0] = 0.0
    out[x >= 1] = 1.0
    ok = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if ok.any():
        xs, as_, bs = x[ok], a[ok], b[ok]
        front = np.exp(_lgamma(as_ + bs) - _lgamma(as_) - _lgamma(bs) + as_ * np.log(xs) + bs * np.log1p(-xs))
        swap = xs > (as_ + 1) / (as_ + bs + 2)
        p = np.where(swap, bs, as_)
        q = np.where(swap, as_, bs)
        z = np.where(swap, 1 - xs, xs)
        value = front * _fraction(p, q, z) / p
        out[ok] = np.where(swap, 1 - value, value)
    return out


def gamma_tail(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(s, x)."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    for i in np.ndindex(x.shape):
        a, v = float(s[i]), float(x[i])
        if math.isnan(a) or math.isnan(v) or a <= 0:
            continue
        if v <= 0:
            out[i] = 1.0
        elif v < a + 1:
            term = total = 1 / a
            k = a
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= v / k
                total += term
            out[i] = 1 - total * math.exp(-v + a * math.log(v) - math.lgamma(a))
        else:
            b = v + 1 - a
            c, d = 1e300, 1 / b
            h = d
            for k in range(1, 1000):
                an = -k * (k - a)
                b += 2
                d = 1 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[i] = h * math.exp(-v + a * math.log(v) - math.lgamma(a))
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Upper quantile by bisection on the tail."""
    df = np.asarray(df, float)
    lo, hi = np.zeros(df.shape), np.full(df.shape, 1e6)
    for _ in range(120):
        mid = (lo + hi) / 2
        above = t_two_sided(mid, df) / 2 > 1 - p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(df > 0, (lo + hi) / 2, np.nan)


@F.pandas_udf(DoubleType())
def p_from_z(z: pd.Series) -> pd.Series:
    """Two-sided P of a normal statistic."""
    return pd.Series(_erfc(np.abs(z.to_numpy(dtype=float, na_value=np.nan)) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def p_from_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided P of a t statistic."""
    return pd.Series(t_two_sided(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def p_from_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of a chi-square statistic."""
    return pd.Series(gamma_tail(df.to_numpy(float, na_value=np.nan) / 2, x.to_numpy(float, na_value=np.nan) / 2))


@F.pandas_udf(DoubleType())
def p_from_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of an F statistic."""
    x, a, b = (s.to_numpy(float, na_value=np.nan) for s in (f, d1, d2))
    return pd.Series(beta_cdf(b / (b + a * x), b / 2, a / 2))


@F.pandas_udf(DoubleType())
def t975(df: pd.Series) -> pd.Series:
    """The 97.5 % quantile of t."""
    return pd.Series(t_quantile(0.975, df.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def sign_test_p(k: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact binomial P of k of n against one half."""
    a, m = k.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan)
    top = np.maximum(a, m - a)
    tail = np.where(top > 0, beta_cdf(0.5, np.maximum(top, 1e-9), m - top + 1), 1.0)
    return pd.Series(np.minimum(1.0, 2 * tail))
