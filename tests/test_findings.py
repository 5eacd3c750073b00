"""Cases in which an earlier version gave other answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexflow.functions import tails
from simplexflow.operators import association, draws, multitest, pooling, quantiles
from simplexflow.plans.fit import fit_pairs, pair_inputs


def test_chi_square_tail_at_large_df():
    for df in (1_999.0, 2_001.0, 1e5, 1e6, 1e7):
        q = df + np.array([-3.0, 0.0, 1.0, 3.0]) * np.sqrt(2 * df)
        z = ((q / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))  # Wilson and Hilferty
        assert np.allclose(tails.gamma_upper(df / 2, q / 2), 1 - tails.normal_cdf(z), atol=2e-4)
    x = np.linspace(900, 1200, 40)
    near = tails.gamma_upper(np.full(40, 999.999), x)
    assert np.allclose(near, tails.gamma_upper(np.full(40, 1000.0), x), atol=2e-5) and (np.diff(near) < 0).all()


def test_chains_of_unequal_length_use_all_draws(spark):
    rng = np.random.default_rng(2)
    chains = [rng.normal(size=1000), rng.normal(size=1000), rng.normal(size=10)]
    rhat, bulk, tail = draws.convergence(chains)
    assert 0.99 < rhat < 1.02 and bulk > 1200 and tail > 1000
    assert draws.convergence([chains[0], chains[1], [1.0, 2.0]])[1] > 1200
    rows = [("a", "b", k, i, "a_ij", float(v)) for k, c in enumerate(chains) for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "`from` string, `to` string, chain int, iter int, variable string, value double")
    assert draws.draw_convergence(df).first().ess_bulk == pytest.approx(bulk)


def test_bartlett_uses_all_its_lags(spark):
    rng = np.random.default_rng(5)
    n, x, y = 400, np.zeros(400), np.zeros(400)
    for t in range(1, n):
        x[t], y[t] = 0.9 * x[t - 1] + rng.normal(), 0.9 * y[t - 1] + rng.normal()
    df = spark.createDataFrame([("s", float(t), float(x[t]), float(y[t])) for t in range(n)], "subject string, time double, x double, y double")
    dx, dy = x - x.mean(), y - y.mean()
    total = sum((1 - k / 21) * (dx[k:] @ dx[:-k]) / (dx @ dx) * (dy[k:] @ dy[:-k]) / (dy @ dy) for k in range(1, 21))
    got = association.effective_n(df, method="bartlett").first()
    assert got.n == n and got.n_eff == pytest.approx(max(4.0, min(n, n / (1 + 2 * total))))



def test_sign_probability_does_not_depend_on_the_clock(spark, small_panel):
    panel, samples = small_panel
    for mode in (dict(compute_elpd=False, smooth=False), dict(compute_elpd=True, kfold_k=3, kfold_r=1, smooth=False)):
        found = []
        for factor in (1.0, 7.0, 1 / 24):
            clock = samples.withColumn("time", F.col("time") * factor)
            edges = fit_pairs(panel, clock, n_phi=6, n_q=6, n_rho=3, **mode)["edges"].toPandas().sort_values(["from", "to"])
            found.append(edges[["p_sign2", "a_mean"]].to_numpy(float))
        assert len(found[0]) and np.allclose(found[0], found[1], atol=1e-6) and np.allclose(found[0], found[2], atol=1e-6)


def test_repeated_times_do_not_depend_on_the_layout(spark, small_panel):
    panel, samples = small_panel
    twice = samples.unionByName(samples.withColumn("sample", F.concat("sample", F.lit("'"))))
    more = panel.unionByName(panel.withColumn("sample", F.concat("sample", F.lit("'"))).withColumn("count", F.col("count") + 1))
    order = ["from", "to", "subject", "time"]
    once = pair_inputs(panel, samples, smooth=False).count()
    seen = [pair_inputs(more.repartition(k), twice.repartition(k, "sample"), smooth=False).toPandas().sort_values(order, ignore_index=True) for k in (1, 5)]
    assert len(seen[0]) == len(seen[1]) >= once * 0.9
    assert np.allclose(seen[0][["y", "xi", "xj"]].to_numpy(float), seen[1][["y", "xi", "xj"]].to_numpy(float))
    assert not seen[0].duplicated(order).any()


def test_pooling_has_no_window_and_keeps_nulls(spark):
    rows = [("a", "b", 0.1, 0.02), ("a", "b", 0.5, 0.05), ("a", "b", None, 0.05), ("a", "b", 0.4, 0.02), ("a", "c", None, None)]
    df = spark.createDataFrame(rows, "i string, j string, z double, v double")
    out = pooling.pool_effects(df, with_p=False)
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {r.j: r for r in out.collect()}
    z, v = np.array([0.1, 0.5, 0.4]), np.array([0.02, 0.05, 0.02])
    w = 1 / v
    q = (w * (z - (w * z).sum() / w.sum()) ** 2).sum()
    tau2 = max(0.0, (q - 2) / (w.sum() - (w * w).sum() / w.sum()))
    ws = 1 / (v + tau2)
    assert got["b"].k == 3 and got["b"].q_stat == pytest.approx(q) and got["b"].tau2 == pytest.approx(tau2)
    assert got["b"].z_pooled == pytest.approx((ws * z).sum() / ws.sum())
    assert got["c"].k == 0 and got["c"].z_pooled is None


def test_missing_values_in_quantiles_and_q(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", float("nan")), ("g", None), ("g", float("inf"))], "g string, x double")
    assert quantiles.exact_quantiles(df, ["g"], "x", {"m": 0.5}).first().m == 2.0
    ps = spark.createDataFrame([(0.01,), (0.02,), (None,), (float("nan"),)], "p double")
    assert sorted((r.q is None) for r in multitest.adjust(ps, "p", "BH").collect()) == [False, False, True, True]
