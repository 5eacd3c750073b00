"""Cubic smoothing splines over the time series of each group.

Spark gathers each (group, chunk) series into one bounded row; the UDF fits it in linear
time from the banded form of the penalised problem (Green and Silverman).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from simplexflow.functions.scalars import finite
from simplexflow.operators.pairs import spread

LOG_LAMBDAS = np.linspace(np.log(1e-9), np.log(1e4), 60)


def spline_path(x, y, weights, lambdas):
    """Fits (L, n) and leverages (L, n) of the smoothing spline for each penalty."""
    n, h = len(x), np.diff(x)
    q0, q1, q2 = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    inv = 1 / weights
    lam = lambdas
    r0, r1 = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
    b0 = q0**2 * inv[:-2] + q1**2 * inv[1:-1] + q2**2 * inv[2:]
    b1 = q1[:-1] * q0[1:] * inv[1:-2] + q2[:-1] * q1[1:] * inv[2:-1]
    b2 = q2[:-2] * q0[2:] * inv[2:-2]
    m = n - 2
    d, l1, l2 = (np.zeros((m, len(lam))) for _ in range(3))
    z = np.zeros((m, len(lam)))
    rhs = q0 * y[:-2] + q1 * y[1:-1] + q2 * y[2:]
    for k in range(m):
        d[k] = r0[k] + lam * b0[k]
        z[k] = rhs[k]
        if k >= 1:
            d[k] -= l1[k - 1] ** 2 * d[k - 1]
            z[k] -= l1[k - 1] * z[k - 1]
        if k >= 2:
            d[k] -= l2[k - 2] ** 2 * d[k - 2]
            z[k] -= l2[k - 2] * z[k - 2]
        if k < m - 1:
            off = r1[k] + lam * b1[k]
            if k >= 1:
                off = off - l1[k - 1] * l2[k - 1] * d[k - 1]
            l1[k] = off / d[k]
        if k < m - 2:
            l2[k] = lam * b2[k] / d[k]
    gamma = z / d
    s0, s1, s2 = (np.zeros((m + 2, len(lam))) for _ in range(3))
    for k in range(m - 1, -1, -1):
        if k < m - 1:
            gamma[k] -= l1[k] * gamma[k + 1]
            s1[k] = -l1[k] * s0[k + 1] - l2[k] * s1[k + 1]
        if k < m - 2:
            gamma[k] -= l2[k] * gamma[k + 2]
            s2[k] = -l1[k] * s1[k + 1] - l2[k] * s0[k + 2]
        s0[k] = 1 / d[k] - l1[k] * s1[k] - l2[k] * s2[k]
    rough = np.zeros((n, len(lam)))
    rough[:-2] += q0[:, None] * gamma
    rough[1:-1] += q1[:, None] * gamma
    rough[2:] += q2[:, None] * gamma
    band = np.zeros((n, len(lam)))
    band[:-2] += q0[:, None] ** 2 * s0[:m]
    band[1:-1] += q1[:, None] ** 2 * s0[:m]
    band[2:] += q2[:, None] ** 2 * s0[:m]
    band[1:-2] += 2 * (q1[:-1] * q0[1:])[:, None] * s1[: m - 1]
    band[2:-1] += 2 * (q2[:-1] * q1[1:])[:, None] * s1[: m - 1]
    if m > 2:
        band[2:-2] += 2 * (q2[:-2] * q0[2:])[:, None] * s2[: m - 2]
    fit = y[:, None] - lam * inv[:, None] * rough
    return fit.T, 1 - (lam * inv[:, None] * band).T


def smooth_one(t, v, df=None, spar=None, cv=True, min_unique=3):
    """Fitted values at ``t`` and the effective degrees of freedom.

    Duplicate times are averaged first.  Penalty, in order: the asked ``df`` (held to
    3 .. min(n - 1, 10)), the asked ``spar``, leave-one-out or generalised cross
    validation, ``df = 4``, a constant.
    """
    times, where, copies = np.unique(t, return_inverse=True, return_counts=True)
    y = np.bincount(where, v) / copies
    n = len(times)
    if n < max(min_unique, 3):
        return np.full(len(t), v.mean()), 1.0
    x = (times - times[0]) / (times[-1] - times[0])
    w = copies.astype(float)
    fits, lev = spline_path(x, y, w, np.exp(LOG_LAMBDAS))
    edf = lev.sum(1)
    if df is not None or spar is None:
        target = None if df is None else min(max(float(df), 3.0), min(n - 1, 10))
        if target is None:
            rss = (w * (y - fits) ** 2).sum(1)
            loo = (w * ((y - fits) / np.maximum(1 - lev, 1e-8)) ** 2).mean(1)
            score = loo if cv else rss / np.maximum(1 - edf / n, 1e-8) ** 2
            pick = LOG_LAMBDAS[int(np.argmin(score))] if np.isfinite(score).all() else None
            target = 4.0 if pick is None else None
        if target is not None:
            pick = float(np.interp(-target, -edf, LOG_LAMBDAS))
    else:
        pick = np.log(256.0 ** (3 * float(spar) - 1) / n)
    fit, lev = spline_path(x, y, w, np.array([np.exp(pick)]))
    if not np.isfinite(fit).all():
        return np.full(len(t), v.mean()), 1.0
    return fit[0][where], float(lev.sum())


def spline_udf(df=None, spar=None, cv=True, min_unique=3):
    """(times, values) arrays to fitted values, with the effective df as last element."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def fit(times: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for t, v in zip(times, values):
            fitted, edf = smooth_one(np.asarray(t, float), np.asarray(v, float), df, spar, cv, min_unique)
            out.append(np.append(fitted, edf))
        return pd.Series(out)

    return fit


def smooth_series(df: DataFrame, by: list[str], time: str, value: str, out: str = "smoothed", *, spline_df=None,
                  spar=None, cv=True, min_unique=3, order=("sample",), together=False) -> DataFrame:
    """Smooth ``value`` over ``time`` in each group; adds ``out`` and ``edf``.

    A group must be bounded: give the chunk as part of ``by``.  Every other column
    rides along in the gathered row.  ``together`` says that the rows of a group already
    share a partition.
    """
    rest = [c for c in df.columns if c not in by]
    rows = F.array_sort(F.collect_list(F.struct(time, *[c for c in order if c in rest],
                                                *[c for c in rest if c != time and c not in order])))
    usable = df.filter(finite(time) & finite(value))
    packed = (usable if together else spread(usable, *by)).groupBy(*by).agg(rows.alias("_rows"))
    fitted = packed.withColumn("_fit", spline_udf(spline_df, spar, cv, min_unique)(f"_rows.{time}", f"_rows.{value}"))
    zipped = F.arrays_zip(F.col("_rows"), F.slice("_fit", F.lit(1), F.size("_rows")).alias("_v"))
    flat = fitted.select(*by, F.element_at("_fit", -1).alias("edf"), F.explode(zipped).alias("_z"))
    return flat.select(*by, "edf", F.col("_z").getField("_rows").alias("_r"), F.col("_z").getField("_v").alias(out)).select(
        *by, *[F.col(f"_r.{c}").alias(c) for c in rest], out, "edf"
    )


def smooth_shares(df: DataFrame, by: list[str], time="time", ra="ra", eps=1e-6, out="ra_s", **options) -> DataFrame:
    """Smooth shares on the log scale and transform back."""
    logged = df.withColumn("_log", F.log(F.col(ra) + F.lit(float(eps))))
    done = smooth_series(logged, by, time, "_log", "_s", **options)
    return done.withColumn(out, F.greatest(F.lit(0.0), F.exp("_s") - F.lit(float(eps)))).drop("_log", "_s")
