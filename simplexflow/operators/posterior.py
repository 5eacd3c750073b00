"""Posterior of the directed regression on a grid, with everything Gaussian in closed form.

Model: y = r0 + r0_subject + a_ii xi + a_ij xj + OU + noise.  Fixed values, the priors:
r0 ~ N(0, 1), a ~ N(0, 0.7), sd_r0 and sigma ~ half-N(0.5), sd_ou ~ half-N(1),
phi ~ Beta(8, 2) on [0.01, 0.99].
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from simplexflow.functions.tails import normal_cdf
from simplexflow.operators.gram import Grid

PRECISION = (1.0, 1 / 0.7**2, 1 / 0.7**2)
LOG_PRECISION = float(np.log(PRECISION).sum())


def student_factor(nu: float | None) -> float:
    """Variance of the noise law relative to sigma squared."""
    if nu is None:
        return 1.0
    return nu / (nu - 2) if nu > 2 else 5.0


def _solve(g, v):
    """Coefficient mean, marginal variances and the parts of the evidence at noise variance v."""
    s00, s11, s22 = (g[..., k] / v + p for k, p in zip((0, 4, 7), PRECISION))
    s01, s02, s12 = g[..., 1] / v, g[..., 2] / v, g[..., 5] / v
    b0, b1, b2 = g[..., 3] / v, g[..., 6] / v, g[..., 8] / v
    c00, c01, c02 = s11 * s22 - s12 * s12, s02 * s12 - s01 * s22, s01 * s12 - s02 * s11
    c11, c12, c22 = s00 * s22 - s02 * s02, s01 * s02 - s00 * s12, s00 * s11 - s01 * s01
    det = s00 * c00 + s01 * c01 + s02 * c02
    m0 = (c00 * b0 + c01 * b1 + c02 * b2) / det
    m1 = (c01 * b0 + c11 * b1 + c12 * b2) / det
    m2 = (c02 * b0 + c12 * b1 + c22 * b2) / det
    quad = b0 * m0 + b1 * m1 + b2 * m2
    inverse = (c00 / det, c01 / det, c02 / det, c11 / det, c12 / det, c22 / det)
    return (m0, m1, m2), inverse, quad, np.log(det)


def log_evidence(g, logdet, n, v):
    """log p(y) with the coefficients integrated out."""
    _, _, quad, log_s = _solve(g, v)
    return -0.5 * (logdet + n * np.log(2 * np.pi * v) + g[..., 9] / v - quad + log_s - LOG_PRECISION)


def noise_centre(g, n):
    """Noise variance near the mode, by a few EM steps from the plain variance of y."""
    v = np.maximum(g[..., 9] / max(n, 1), 1e-12)
    for _ in range(6):
        (m0, m1, m2), (k00, k01, k02, k11, k12, k22), _, _ = _solve(g, v)
        fit = m0 * g[..., 3] + m1 * g[..., 6] + m2 * g[..., 8]
        square = (
            m0 * m0 * g[..., 0] + m1 * m1 * g[..., 4] + m2 * m2 * g[..., 7]
            + 2 * (m0 * m1 * g[..., 1] + m0 * m2 * g[..., 2] + m1 * m2 * g[..., 5])
        )
        spread = k00 * g[..., 0] + k11 * g[..., 4] + k22 * g[..., 7]
        spread = spread + 2 * (k01 * g[..., 1] + k02 * g[..., 2] + k12 * g[..., 5])
        v = np.maximum((g[..., 9] - 2 * fit + square + spread) / max(n, 1), 1e-12)
    return v


@dataclass
class Posterior:
    """Kept grid points: indexes, noise variance, normalised log weight, evidence."""

    cell: np.ndarray
    v: np.ndarray
    log_w: np.ndarray
    evidence: np.ndarray
    gram: np.ndarray
    logdet: np.ndarray
    edge_mass: float
    n: float


def log_prior(phi, q, rho, v, factor: float):
    """Prior of a grid point in (phi, log q, log rho, log v), up to a constant."""
    noise_sd = np.sqrt(v)
    sigma, tau = np.sqrt(v / factor), rho * noise_sd
    out = -0.5 * (sigma / 0.5) ** 2 + np.log(sigma) - 0.5 * (tau / 0.5) ** 2 + np.log(tau)
    if np.max(q) > 0:
        share, sd_ou = (phi - 0.01) / 0.98, q * noise_sd
        out = out - 0.5 * sd_ou**2 + np.log(sd_ou) + 7 * np.log(share) + np.log1p(-share)
    return out


def fit_grid(gram, logdet, n, grid: Grid, nu: float | None, keep: float = 1e-9) -> Posterior:
    """Weights of all grid points from summed cross products (G, R, 10) and (G, R).

    The noise scale gets its own points around its mode in every cell, spaced by its
    posterior sd, so they stay fine however many rows there are.  Cells whose mode is
    below the best by 30 log units, and points lighter than ``keep`` times the heaviest,
    are left out; ``edge_mass`` is the weight on the largest phi and rho (a large q only
    says that there is hardly any white noise).
    """
    phi, q = grid.points
    rho, factor = np.array(grid.rho), student_factor(nu)
    centre = noise_centre(gram, n)
    mode = log_evidence(gram, logdet, n, centre) + log_prior(phi[:, None], q[:, None], rho[None, :], centre, factor)
    cell = np.stack(np.nonzero(mode > mode.max() - 30))
    g, d = gram[cell[0], cell[1]], logdet[cell[0], cell[1]]
    v = centre[cell[0], cell[1]][:, None] * np.exp(np.array(grid.steps) * np.sqrt(2.0 / max(n, 1)))
    evidence = log_evidence(g[:, None, :], d[:, None], n, v)
    log_w = evidence + log_prior(phi[cell[0]][:, None], q[cell[0]][:, None], rho[cell[1]][:, None], v, factor)
    top = log_w.max()
    weight = np.exp(log_w - top)
    total = weight.sum()
    last = cell[1] == len(rho) - 1
    if q.max() > 0:
        last = last | (cell[0] >= len(phi) - len(grid.q))
    row, step = np.nonzero(weight > keep)
    return Posterior(
        cell[:, row], v[row, step], log_w[row, step] - top - np.log(total), evidence[row, step],
        g[row], d[row], float(weight[last].sum() / total), float(n),
    )


def _mixture(w, mean, sd):
    """Mean, sd, 2.5% and 97.5% points and P(> 0) of a normal mixture."""
    centre = float((w * mean).sum())
    spread = float(np.sqrt(max((w * (sd**2 + (mean - centre) ** 2)).sum(), 0.0)))
    points = []
    for target, start in ((0.025, -1.96), (0.975, 1.96)):
        low, high = centre - 12 * spread - 1e-12, centre + 12 * spread + 1e-12
        x = centre + start * spread
        for _ in range(60):
            z = (x - mean) / sd
            gap = float((w * normal_cdf(z)).sum()) - target
            low, high = (x, high) if gap < 0 else (low, x)
            slope = float((w * np.exp(-0.5 * z * z) / sd).sum()) / np.sqrt(2 * np.pi)
            step = x - gap / slope if slope > 0 else np.inf
            nxt = step if low < step < high else (low + high) / 2
            if abs(nxt - x) < 1e-10 * spread:
                break
            x = nxt
        points.append(x)
    return [centre, spread, points[0], points[1], float((w * normal_cdf(mean / sd)).sum())]


SUMMARY = [f"{p}_{s}" for p in ("r0", "a_self", "a") for s in ("mean", "sd", "q2_5", "q97_5", "p_pos")] + [
    "phi_mean", "sigma_mean", "sd_ou_mean", "sd_r0_mean", "lambda_mean", "sigma_ou_mean", "sigma_pred_mean",
    "grid_edge_mass", "grid_points", "log_evidence",
]


def summarise(post: Posterior, grid: Grid, nu: float | None, unit: float) -> list[float]:
    """The values named in ``SUMMARY``."""
    w = np.exp(post.log_w)
    w = w / w.sum()
    (m0, m1, m2), inverse, _, _ = _solve(post.gram, post.v)
    out = []
    for mean, var in ((m0, inverse[0]), (m1, inverse[3]), (m2, inverse[5])):
        out += _mixture(w, mean, np.sqrt(var))
    phi, q = grid.points
    phi, q, rho = phi[post.cell[0]], q[post.cell[0]], np.array(grid.rho)[post.cell[1]]
    noise = np.sqrt(post.v)
    sigma, sd_ou, sd_r0 = noise / np.sqrt(student_factor(nu)), q * noise, rho * noise
    lam = -np.log(phi) / unit
    derived = [phi, sigma, sd_ou, sd_r0, lam, sd_ou * np.sqrt(2 * lam), np.sqrt(post.v + sd_ou**2)]
    out += [float((w * d).sum()) for d in derived]
    top = (post.evidence + post.log_w).max()
    return out + [post.edge_mass, float(1 / (w**2).sum()), float(top)]


def held_out_score(post: Posterior, gram, logdet, n) -> float:
    """log p(held-out series | training data).

    At one grid point it is the evidence of both minus the evidence of training alone;
    points are mixed with the training weights.
    """
    g, r = post.cell
    both = log_evidence(post.gram + gram[g, r], post.logdet + logdet[g, r], post.n + n, post.v)
    terms = post.log_w + both - post.evidence
    top = terms.max()
    return float(top + np.log(np.exp(terms - top).sum()))
