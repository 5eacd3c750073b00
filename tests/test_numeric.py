"""Numeric helpers against dense or closed-form references."""

import numpy as np
import pytest

from simplexflow.functions import tails
from simplexflow.operators import draws, gram, multitest, posterior, smooth, weights


def test_t_tail_matches_closed_forms():
    t = np.array([0.5, 1.0, 2.5, 7.0])
    assert np.allclose(tails.t_two_sided(t, 1), 1 - 2 / np.pi * np.arctan(t), atol=1e-12)
    assert np.allclose(tails.t_two_sided(t, 2), 1 - t / np.sqrt(2 + t * t), atol=1e-12)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_quantile(0.975, np.array([10.0]))[0] == pytest.approx(2.228138852, abs=1e-7)


def test_t_tail_approaches_normal():
    assert tails.t_two_sided(1.96, 1e7) == pytest.approx(2 * (1 - tails.normal_cdf(1.96)), abs=1e-6)


def test_chi_square_tail():
    q = np.array([0.1, 1.0, 5.0, 40.0])
    assert np.allclose(tails.gamma_upper(1.0, q / 2), np.exp(-q / 2), atol=1e-13)
    assert np.allclose(tails.gamma_upper(0.5, q / 2), 2 * (1 - tails.normal_cdf(np.sqrt(q))), atol=1e-12)


def _series(rng, n=14):
    t = np.cumsum(rng.uniform(0.3, 2.0, n))
    cols = np.column_stack([np.ones(n), rng.normal(size=(n, 3))])
    return t, cols


def _cov(t, phi, q2):
    return np.eye(len(t)) + q2 * phi ** np.abs(t[:, None] - t[None, :])


def test_whitened_gram_equals_dense_gls():
    rng = np.random.default_rng(1)
    t, cols = _series(rng)
    gap = np.diff(t, prepend=t[:1])[None]
    g, d = gram.whitened_gram(cols[None], gap, np.ones_like(gap), np.array([0.4, 0.9]), np.array([0.5, 2.0]))
    for k, (phi, q2) in enumerate([(0.4, 0.5), (0.9, 2.0)]):
        v = _cov(t, phi, q2)
        dense = cols.T @ np.linalg.solve(v, cols)
        assert np.allclose(g[0, k], [dense[a, b] for a, b in gram.UPPER], rtol=1e-9)
        assert d[0, k] == pytest.approx(np.linalg.slogdet(v)[1], rel=1e-9)


def test_random_intercept_is_rank_one():
    rng = np.random.default_rng(2)
    t, cols = _series(rng)
    gap = np.diff(t, prepend=t[:1])[None]
    g, d = gram.whitened_gram(cols[None], gap, np.ones_like(gap), np.array([0.7]), np.array([0.8]))
    full, det = gram.with_intercepts(g, d, np.array([0.3, 4.0]))
    for k, rho2 in enumerate((0.3, 4.0)):
        v = _cov(t, 0.7, 0.8) + rho2
        dense = cols.T @ np.linalg.solve(v, cols)
        assert np.allclose(full[0, 0, k], [dense[a, b] for a, b in gram.UPPER], rtol=1e-8)
        assert det[0, 0, k] == pytest.approx(np.linalg.slogdet(v)[1], rel=1e-9)


def test_rescale_is_the_same_as_scaling_first():
    rng = np.random.default_rng(3)
    t, cols = _series(rng)
    gap = np.diff(t, prepend=t[:1])[None]
    args = (np.ones_like(gap), np.array([0.6]), np.array([1.0]))
    g, _ = gram.whitened_gram(cols[None], gap, *args)
    scaled = cols.copy()
    scaled[:, 1] = (scaled[:, 1] - 0.3) / 1.7
    scaled[:, 2] = (scaled[:, 2] + 0.2) / 0.6
    scaled[:, 3] = (scaled[:, 3] - 0.1) / 2.5
    again, _ = gram.whitened_gram(scaled[None], gap, *args)
    assert np.allclose(gram.rescale(g, 0.3, 1.7, -0.2, 0.6, 0.1, 2.5), again)


def test_padding_does_not_change_a_series():
    rng = np.random.default_rng(4)
    short, long = _series(rng, 6)[1], _series(rng, 15)[1]
    block, mask = gram.pad([short, long])
    gap = np.ones(mask.shape)
    both, _ = gram.whitened_gram(block, gap, mask.astype(float), np.array([0.5]), np.array([1.0]))
    alone, _ = gram.whitened_gram(short[None], gap[:1, :6], np.ones((1, 6)), np.array([0.5]), np.array([1.0]))
    assert np.allclose(both[0], alone[0])


def _dense_log_density(y, x, cov, v):
    """log N(y; 0, v cov + x diag(prior) x')."""
    total = v * cov + x @ np.diag(1 / np.array(posterior.PRECISION)) @ x.T
    sign, det = np.linalg.slogdet(total)
    return -0.5 * (len(y) * np.log(2 * np.pi) + det + y @ np.linalg.solve(total, y))


def test_evidence_and_held_out_score_match_dense():
    rng = np.random.default_rng(5)
    t, cols = _series(rng, 12)
    gap = np.diff(t, prepend=t[:1])[None]
    g, d = gram.whitened_gram(cols[None], gap, np.ones_like(gap), np.array([0.6]), np.array([0.9]))
    v = 0.7
    dense = _dense_log_density(cols[:, 3], cols[:, :3], _cov(t, 0.6, 0.9), v)
    assert posterior.log_evidence(g[0, 0], d[0, 0], 12, v) == pytest.approx(dense, rel=1e-9)


def _simulate(rng, subjects=10, n=14, a=0.4):
    out = []
    for _ in range(subjects):
        t = np.cumsum(rng.uniform(0.5, 1.5, n))
        xi, xj = rng.normal(size=n), rng.normal(size=n)
        ou = np.linalg.cholesky(0.16 * 0.7 ** np.abs(t[:, None] - t[None, :]) + 1e-12 * np.eye(n)) @ rng.normal(size=n)
        y = 0.1 + 0.2 * rng.normal() - 0.4 * xi + a * xj + ou + 0.3 * rng.normal(size=n)
        out.append((t, np.column_stack([np.ones(n), xi, xj, y])))
    return out


def _sums(series, grid):
    phi, q = grid.points
    total, det, n = 0, 0, 0
    for t, cols in series:
        gap = np.diff(t, prepend=t[:1])[None]
        g, d = gram.whitened_gram(cols[None], gap, np.ones_like(gap), phi, q**2)
        g, d = gram.with_intercepts(g[0], d[0], np.array(grid.rho) ** 2)
        total, det, n = total + g, det + d, n + len(t)
    return total, det, n


def test_posterior_recovers_the_interaction():
    rng = np.random.default_rng(11)
    grid = gram.Grid.default()
    covered = 0
    for a in (0.4, -0.3, 0.0, 0.2, 0.5):
        post = posterior.fit_grid(*_sums(_simulate(rng, a=a), grid), grid, None)
        values = dict(zip(posterior.SUMMARY, posterior.summarise(post, grid, None, 1.0)))
        covered += values["a_q2_5"] <= a <= values["a_q97_5"]
        assert abs(values["a_mean"] - a) < 0.2
    assert covered >= 4


def test_finer_grid_gives_the_same_answer():
    rng = np.random.default_rng(12)
    series = _simulate(rng)
    means = []
    for size in (12, 16):
        grid = gram.Grid.default(size, size, 7 if size == 16 else 5)
        post = posterior.fit_grid(*_sums(series, grid), grid, 5.0)
        means.append(posterior.summarise(post, grid, 5.0, 1.0)[10:12])
    assert means[0][0] == pytest.approx(means[1][0], abs=0.1 * means[1][1])
    assert means[0][1] == pytest.approx(means[1][1], rel=0.1)


def test_spline_matches_dense_solution():
    rng = np.random.default_rng(6)
    x = np.sort(rng.uniform(0, 1, 12))
    y, w = rng.normal(size=12), rng.uniform(0.5, 2, 12)
    h = np.diff(x)
    q, r = np.zeros((12, 10)), np.zeros((10, 10))
    for k in range(10):
        q[k, k], q[k + 1, k], q[k + 2, k] = 1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]
        r[k, k] = (h[k] + h[k + 1]) / 3
        if k:
            r[k, k - 1] = r[k - 1, k] = h[k] / 6
    lam = 1e-3
    hat = np.linalg.solve(np.diag(w) + lam * q @ np.linalg.solve(r, q.T), np.diag(w))
    fit, lev = smooth.spline_path(x, y, w, np.array([lam]))
    assert np.allclose(fit[0], hat @ y)
    assert np.allclose(lev[0], np.diag(hat))


def test_smoother_keeps_lines_and_constants():
    t = np.array([0.0, 1.0, 2.5, 3.0, 4.0, 7.0])
    fitted, edf = smooth.smooth_one(t, 2 - 0.5 * t)
    assert np.allclose(fitted, 2 - 0.5 * t, atol=1e-5)
    flat, edf = smooth.smooth_one(np.array([1.0, 1.0, 2.0]), np.array([1.0, 3.0, 5.0]))
    assert np.allclose(flat, 3.0) and edf == 1.0
    _, edf = smooth.smooth_one(t, np.sin(t), df=4)
    assert edf == pytest.approx(4, abs=0.05)


def test_lambda_smoother_row_keeps_constants_and_lines():
    row, lam = np.array(multitest.smoother_row()), np.array(multitest.LAMBDAS)
    assert row.sum() == pytest.approx(1)
    assert row @ lam == pytest.approx(lam[-1])


def test_stacking_prefers_the_better_model():
    rng = np.random.default_rng(8)
    good = rng.normal(-1, 0.1, 40)
    w = weights.stack(np.column_stack([good, good - 3, good - 3]))
    assert w[0] > 0.99 and w.sum() == pytest.approx(1)
    even = weights.stack(np.column_stack([[0.0, -9.0] * 10, [-9.0, 0.0] * 10]))
    assert np.allclose(even, 0.5, atol=1e-6)


def test_convergence_of_independent_and_stuck_chains():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4, 500))
    rhat, bulk, tail = draws.convergence(x)
    assert rhat < 1.02 and bulk > 1200 and tail > 800
    rhat, bulk, _ = draws.convergence(x + np.array([[0.0], [0.0], [3.0], [3.0]]))
    assert rhat > 1.5 and bulk < 50
