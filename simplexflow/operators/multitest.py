"""False discovery rates over all pairs without a global sort.

Pairs with equal p share one q, so the work is done on distinct p values, cut into bins
by a fixed increasing function of p.  Running counts and minima are taken inside a bin;
one row per bin (at most a few thousand) carries them across bins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from simplexflow.functions.scalars import check_choice, finite

Q_METHODS = ("BH", "BY", "wBH", "qvalue", "wqvalue")
LAMBDAS = [round(0.05 * k, 2) for k in range(1, 20)]


def p_bin(p: Column) -> Column:
    """At most 4,700 bins: equal steps of log p below 0.01, equal steps of p above."""
    low = F.floor((F.log10(F.greatest(p, F.lit(1e-300))) + 300) * 2)
    return F.when(p < 0.01, low).otherwise(F.lit(600) + F.floor(p * 4096)).cast("int")


def step_up(df: DataFrame, p: str, q: str, scale: Column | None = None) -> DataFrame:
    """Adjusted p by the step-up rule; null p stays null and is not counted.

    ``scale`` multiplies every adjusted value (a harmonic sum or pi0).
    """
    valid = df.filter(finite(p)).select(F.col(p).alias("_p"))
    distinct = valid.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_bin", p_bin(F.col("_p")))
    bins = distinct.groupBy("_bin").agg(F.sum("_n").alias("_bin_n"))
    # The window below has one row per bin, a number fixed by p_bin and not by the data.
    before = W.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_bin_n").over(before), F.lit(0)))
    total = valid.agg(F.count("*").alias("m")).scalar()
    inside = W.partitionBy("_bin").orderBy("_p")
    ranked = distinct.join(F.broadcast(bins), "_bin").withColumn(
        "_rank", F.col("_before") + F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    raw = F.col("_p") * total / F.col("_rank") * (F.lit(1.0) if scale is None else scale)
    ranked = ranked.withColumn("_raw", raw).withColumn(
        "_own", F.min("_raw").over(inside.rowsBetween(0, W.unboundedFollowing))
    )
    floor = ranked.groupBy("_bin").agg(F.min("_raw").alias("_bin_min"))
    after = W.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(1, W.unboundedFollowing)
    floor = floor.withColumn("_later", F.min("_bin_min").over(after)).drop("_bin_min")
    adjusted = ranked.join(F.broadcast(floor), "_bin").select(
        "_p", F.least(F.lit(1.0), F.col("_own"), F.col("_later")).alias(q)
    )
    tested = df.filter(finite(p)).join(adjusted, F.col(p) == F.col("_p"), "left").drop("_p")
    return tested.unionByName(df.filter(~finite(p)).withColumn(q, F.lit(None).cast("double")))  # not all on one key


def harmonic(df: DataFrame, p: str) -> Column:
    """1 + 1/2 + ... + 1/m for the number of tests, by its closed expansion above 1,000."""
    counted = df.filter(finite(p)).agg(F.count("*").alias("m"))
    m = F.col("m")
    upto = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(m, F.lit(1000))).cast("int"))
    exact = F.aggregate(upto, F.lit(0.0), lambda a, k: a + 1 / k)
    wide = F.log(m) + F.lit(0.57721566490153286) + 1 / (2 * m) - 1 / (12 * m * m)
    return counted.select(F.when(m <= 1000, exact).otherwise(wide)).scalar()


def rank_weights(df: DataFrame, by: str | None) -> Column:
    """Positive weights with mean one; a missing or non-positive weight counts as one."""
    check_choice("q_weight_by", by, ("k", "n_median", "n_effin_median", "none", None))
    if by in (None, "none"):
        return F.lit(1.0)
    good = F.when(finite(by) & (F.col(by) > 0), F.col(by).cast("double")).otherwise(F.lit(1.0))
    return good / df.agg(F.avg(good).alias("m")).scalar()


def smoother_row(df_target: float = 3.0) -> list[float]:
    """Row of a cubic smoothing spline on the 19 lambdas that gives the value at the last.

    The penalty is set so the trace of the smoother equals ``df_target``.
    """
    x = np.array(LAMBDAS)
    n, h = len(x), np.diff(np.array(LAMBDAS))
    q = np.zeros((n, n - 2))
    r = np.zeros((n - 2, n - 2))
    for k in range(n - 2):
        q[k, k], q[k + 1, k], q[k + 2, k] = 1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]
        r[k, k] = (h[k] + h[k + 1]) / 3
        if k:
            r[k, k - 1] = r[k - 1, k] = h[k] / 6
    values, vectors = np.linalg.eigh(q @ np.linalg.solve(r, q.T))
    low, high = -30.0, 30.0
    for _ in range(200):
        mid = (low + high) / 2
        trace = (1 / (1 + np.exp(mid) * np.clip(values, 0, None))).sum()
        low, high = (mid, high) if trace > df_target else (low, mid)
    gain = 1 / (1 + np.exp((low + high) / 2) * np.clip(values, 0, None))
    return [float(v) for v in (vectors * gain @ vectors.T)[-1]]


def null_share(df: DataFrame, p: str) -> Column:
    """Storey's share of true nulls, one aggregate over the p values; 1 when it fails."""
    valid = df.filter(finite(p))
    tails = [F.avg(F.when(F.col(p) >= lam, 1.0).otherwise(0.0)) / (1 - lam) for lam in LAMBDAS]
    pi0 = F.lit(0.0)
    for weight, tail in zip(smoother_row(), tails):
        pi0 = pi0 + F.lit(float(weight)) * tail
    value = valid.agg(pi0.alias("pi0")).scalar()
    return F.when((value > 0) & finite(value), F.least(value, F.lit(1.0))).otherwise(F.lit(1.0))


def adjust(df: DataFrame, p: str = "p", method: str = "BH", weight_by: str | None = "k", q: str = "q") -> DataFrame:
    """Add ``q`` and ``q_weight`` for the chosen method."""
    check_choice("q_method", method, Q_METHODS)
    weighted = method in ("wBH", "wqvalue")
    if weighted:
        df = df.withColumn("_weight", rank_weights(df, weight_by))
        df = df.withColumn("_pw", F.when(finite(p), F.least(F.lit(1.0), F.col(p) / F.col("_weight"))))
    used = "_pw" if weighted else p
    scale = harmonic(df, used) if method == "BY" else null_share(df, used) if "qvalue" in method else None
    label = (weight_by or "none") if weighted else "none"
    return step_up(df, used, q, scale).drop("_pw", "_weight").withColumn("q_weight", F.lit(label))
