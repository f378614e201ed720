"""K1: tail probabilities of the normal, Student t and chi-square
distributions, as plain Python and as Arrow-batched pandas UDFs.

Spark has no erf/erfc or incomplete gamma/beta and scipy is not installed;
the statistic tables these run on are tiny (one row per feature pair,
variable or model pair), so a vectorised helper per batch is enough.
Algorithms: erfc from the C library; regularized incomplete gamma by series
/ continued fraction; regularized incomplete beta by Lentz's continued
fraction (textbook forms).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_FPMIN = 1e-300


def normal_sf(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _gamma_series(a: float, x: float) -> float:
    ap, total, delta = a, 1.0 / a, 1.0 / a
    for _ in range(10_000):
        ap += 1.0
        delta *= x / ap
        total += delta
        if abs(delta) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_cf(a: float, x: float) -> float:
    b = x + 1.0 - a
    c = 1.0 / _FPMIN
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _FPMIN if abs(d) < _FPMIN else d
        c = b + an / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_series(a, x)
    return _gamma_cf(a, x)


def chi2_sf(x: float, df: float) -> float:
    """P(χ²_df > x)."""
    return gamma_q(df / 2.0, x / 2.0)


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = _FPMIN if abs(d) < _FPMIN else d
    d = 1.0 / d
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _FPMIN if abs(d) < _FPMIN else d
        c = 1.0 + aa / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _FPMIN if abs(d) < _FPMIN else d
        c = 1.0 + aa / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _beta_cf(a, b, x) / a
    return 1.0 - bt * _beta_cf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    """P(|T_df| > |t|)."""
    if math.isinf(t):
        return 0.0
    if math.isnan(t):
        return math.nan
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def _vec(fn, *cols):
    arrs = [np.asarray(c, dtype="float64") for c in cols]
    out = np.empty(len(arrs[0]), dtype="float64")
    for i in range(len(out)):
        vals = [a[i] for a in arrs]
        out[i] = math.nan if any(math.isnan(v) for v in vals) else fn(*vals)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def normal_two_sided_p_udf(z: pd.Series) -> pd.Series:
    return _vec(lambda v: min(1.0, 2.0 * normal_sf(abs(v))), z)


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(chi2_sf, x, df)


@F.pandas_udf(T.DoubleType())
def t_two_sided_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_two_sided_p, t, df)
