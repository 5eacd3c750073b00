"""Tail areas of the normal, Student-t and chi-square laws as Arrow UDFs.

Spark SQL has neither ``erf`` nor the incomplete gamma and beta functions.  The UDFs
run on rows that are already one per pair, never on the panel.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x):
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def normal_cdf(x):
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def _beta_fraction(a, b, x, steps=300):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    safe = np.clip(xx, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(safe) + bb * np.log1p(-safe))
    value = np.where(xx <= 0, 0.0, front * _beta_fraction(aa, bb, safe) / aa)
    return np.where(flip, 1 - value, value)


def t_two_sided(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = np.isfinite(t) & (df > 0)
    tt, dd = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, beta_inc(dd / 2, 0.5, dd / (dd + tt * tt)), np.where(np.isinf(t) & (df > 0), 0.0, np.nan))


def t_quantile(p, df):
    """Upper quantile by bisection on the two-sided tail, p > 0.5."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low, high = np.zeros(df.shape), np.full(df.shape, 1e6)
    for _ in range(90):
        mid = (low + high) / 2
        above = t_two_sided(mid, df) / 2 > 1 - p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


#: From this shape on, the uniform expansion is used; its error is below 1e-9 there.
LARGE_SHAPE = 1000.0


def _gamma_upper_large(a, x):
    """Temme's uniform expansion of Q(a, x) with two terms, good near and far from x = a."""
    mu = (x - a) / a
    with np.errstate(divide="ignore", invalid="ignore"):
        eta = np.sign(mu) * np.sqrt(np.maximum(2 * (mu - np.log1p(mu)), 0.0))
        far0 = 1 / mu - 1 / eta
        far1 = 1 / eta**3 - 1 / mu**3 - 1 / mu**2 - 1 / (12 * mu)
        near = np.abs(eta) < 0.05
        c0 = np.where(near, -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864 + eta**4 / 2835, far0)
        c1 = np.where(near, -1 / 540 - eta / 288 + 25 * eta**2 / 12096, far1)
        rest = np.exp(-0.5 * a * eta * eta) / np.sqrt(2 * np.pi * a) * (c0 + c1 / a)
    return 0.5 * np.asarray(_erfc(eta * np.sqrt(a / 2)), float) + rest


def gamma_upper(a, x):
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, fraction above, an expansion for large a."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    large = a >= LARGE_SHAPE
    shape = np.where(large, 1.0, a)
    safe = np.where(large, 1.0, np.maximum(x, 1e-300))
    front = np.exp(shape * np.log(safe) - safe - lgamma(shape))
    term = 1 / shape
    total = term.copy()
    with np.errstate(over="ignore", invalid="ignore"):
        below = safe < shape + 1
        n = 0
        while (below & (term > 1e-17 * total)).any():
            n += 1
            term = term * safe / (shape + n)
            total = total + term
        b = safe + 1 - shape
        c = np.full_like(b, 1e300)
        d = 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        n, moved = 0, ~below
        while moved.any():
            n += 1
            an = -n * (n - shape)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            moved = moved & (np.abs(d * c - 1) > 1e-16) & (n < 100_000)
        out = np.where(below, 1 - front * total, front * h)
    if large.any():
        out = np.where(large, _gamma_upper_large(np.where(large, a, LARGE_SHAPE), np.where(large, np.maximum(x, 1e-300), LARGE_SHAPE)), out)
    return np.where(x <= 0, 1.0, np.clip(out, 0.0, 1.0))


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    z = z.to_numpy(float)
    out = np.asarray(_erfc(np.abs(np.nan_to_num(z)) / math.sqrt(2)), float)
    return pd.Series(out).where(~np.isnan(z), None)


@F.pandas_udf(DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    out = t_two_sided(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(out).where(np.isfinite(out), None)


@F.pandas_udf(DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    values, where = np.unique(df.fillna(-1).to_numpy(float), return_inverse=True)
    good = values > 0
    out = np.full(values.shape, np.nan)
    if good.any():
        out[good] = t_quantile(0.975, values[good])
    return pd.Series(out[where]).where(np.isfinite(out[where]), None)


@F.pandas_udf(DoubleType())
def chi2_upper_p(q: pd.Series, df: pd.Series) -> pd.Series:
    q, d = q.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(q) & (d > 0)
    out = np.full(q.shape, np.nan)
    if ok.any():
        out[ok] = gamma_upper(d[ok] / 2, q[ok] / 2)
    return pd.Series(out).where(ok, None)


Z975 = NormalDist().inv_cdf(0.975)
