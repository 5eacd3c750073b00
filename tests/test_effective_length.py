"""Effective lengths of ranks and residuals, in one chunk, in many, and at long lags."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexflow.operators import association as A
from simplexflow.plans.screen import ScreenOptions, subject_table

WAYS = {
    "spearman": dict(method="spearman"),
    "residuals": dict(transform="raw", partial_rest=True),
    "rank residuals": dict(transform="raw", partial_rest=True, method="spearman"),
    "matrix residuals": dict(transform="raw", partial_rest=True, partial_method="matrix"),
    "matrix ranks": dict(transform="raw", partial_rest=True, partial_method="matrix", method="spearman", effn_method="bartlett"),
}


def rows(df):
    return {(r["i"], r["j"], r["subject"]): (r["n"], r["r"], r["n_eff_raw"]) for r in df.collect()}


@pytest.mark.parametrize("way", WAYS)
def test_chunks_do_not_change_effective_length(spark, small_panel, way):
    whole = rows(subject_table(*small_panel, o=ScreenOptions(**WAYS[way])))
    cut = rows(subject_table(*small_panel, o=ScreenOptions(**WAYS[way], chunk_rows=10)))
    assert whole and whole.keys() == cut.keys()
    for key, (n, r, raw) in whole.items():
        assert cut[key][0] == n and cut[key][1:] == pytest.approx((r, raw), rel=1e-9, abs=1e-9)


def plain_rank(x):
    x = np.round(np.asarray(x), 9)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def plain_length(x, y, lags):
    n = len(x)
    rho = []
    for v in (x, y):
        d = v - v.mean()
        rho.append([np.clip((d[k:] * d[:-k]).sum() / (d * d).sum(), -0.99, 0.99) for k in range(1, lags + 1)])
    total = sum((1 - k / (lags + 1)) * a * b for k, (a, b) in enumerate(zip(*rho), 1))
    return min(max(n / max(1 + 2 * total, 1e-6), 4), n)


def test_effective_length_of_residuals_in_numpy(spark, small_panel):
    panel, samples = small_panel
    wide = panel.join(samples, "sample").groupBy("subject", "time").pivot("taxon").sum("count").fillna(0).orderBy("subject", "time").toPandas()
    got = rows(subject_table(panel, samples, o=ScreenOptions(transform="raw", partial_rest=True, method="spearman")))
    for subject, part in wide.groupby("subject"):
        counts = part[["t0", "t1", "t2", "t3"]].to_numpy()
        shares = counts / counts.sum(axis=1, keepdims=True)
        for a, b in [(1, 2), (2, 3)]:
            x, y, z = plain_rank(shares[:, a]), plain_rank(shares[:, b]), plain_rank(np.maximum(0, 1 - shares[:, a] - shares[:, b]))
            ex, ey = (v - v.mean() - np.cov(v, z)[0, 1] / z.var(ddof=1) * (z - z.mean()) for v in (x, y))
            lags = max(1, int(4 * (len(x) / 100) ** (2 / 9)))
            assert got[f"t{a}", f"t{b}", subject][2] == pytest.approx(plain_length(ex, ey, lags), rel=1e-9)


def test_lags_longer_than_a_chunk_are_refused(spark, small_panel):
    with pytest.raises(ValueError, match="chunk"):
        subject_table(*small_panel, o=ScreenOptions(effn_L=15, chunk_rows=10))


@pytest.mark.parametrize("method,bandwidth,block", [("bartlett", None, 64), ("nw", 700, 256), ("nw", 40, 4096), ("ar1", None, 50)])
def test_blocked_autocovariance_equals_direct_sums(spark, method, bandwidth, block):
    rng = np.random.default_rng(2)
    series = {}
    for s, n in (("a", 1500), ("b", 37), ("c", 3), ("d", 5)):
        series[s] = [np.cumsum(rng.normal(size=n)) * 0.1 + rng.normal(size=n) for _ in range(2)]
    series["e"] = [np.ones(30), rng.normal(size=30)]
    data = [(s, float(k), float(x), float(y)) for s, (xs, ys) in series.items() for k, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(data, "subject string, time double, x double, y double").repartition(3, "time")
    got = {r["subject"]: (r["n"], r["n_eff"]) for r in A.effective_n(df, method=method, bandwidth=bandwidth, block=block).collect()}
    for s, (x, y) in series.items():
        n = len(x)
        if n < 5:
            assert got[s] == (n, None)
            continue
        if method == "ar1":
            rho = [(d[1:] * d[:-1]).sum() / (d * d).sum() if (d := v - v.mean()).any() else 0 for v in (x, y)]
            phi = np.clip(rho[0] * rho[1], -0.95, 0.95)
            want = min(max(n * (1 - phi) / (1 + phi), 4), n)
        else:
            lags = min(bandwidth, n - 1) if bandwidth else int(np.sqrt(n))
            want = n if not np.ptp(x) else plain_length(x, y, lags)
        assert got[s][1] == pytest.approx(want, rel=1e-9)


def test_blocked_rows_do_not_grow_with_the_lags(spark):
    df = spark.range(2000).select(F.lit("s").alias("subject"), F.col("id").cast("double").alias("time"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    plans = [A.effective_n(df, bandwidth=b)._jdf.queryExecution().optimizedPlan().toString() for b in (3, 600)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
