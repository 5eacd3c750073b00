"""Whitened cross products of a series under Ornstein-Uhlenbeck plus white noise.

Given the correlation ``phi`` per time unit and the variance ratio q2 = sd_ou^2 / var_noise, a
scalar Kalman filter turns the columns [1, xi, xj, y] into independent unit-variance
innovations.  Only their 4 x 4 cross product, the log-determinant and the row count are
kept.  These add up over subjects, so nothing else needs to leave the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Upper triangle of the cross product of [1, xi, xj, y], row by row.
UPPER = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]


@dataclass(frozen=True)
class Grid:
    """Points for the non-Gaussian parameters.  Ratios are to the noise sd."""

    phi: tuple
    q: tuple
    rho: tuple
    steps: tuple = tuple(np.linspace(-5.0, 5.0, 11))

    @staticmethod
    def default(n_phi: int = 12, n_q: int = 12, n_rho: int = 5, white: bool = False) -> "Grid":
        edges = np.linspace(0.01, 0.99, n_phi + 1)
        phi = (edges[1:] + edges[:-1]) / 2
        q = np.exp(np.linspace(np.log(0.02), np.log(30.0), n_q))
        rho = np.exp(np.linspace(np.log(0.03), np.log(3.0), n_rho))
        return Grid((0.5,) if white else tuple(phi), (0.0,) if white else tuple(q), tuple(rho))

    @property
    def points(self):
        """phi and q of each filter, flattened."""
        p, q = np.meshgrid(np.array(self.phi), np.array(self.q), indexing="ij")
        return p.ravel(), q.ravel()


def pad(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Stack ragged series of equal width into one padded block and a row mask."""
    longest = max(len(s) for s in series)
    block = np.zeros((len(series), longest, series[0].shape[1]))
    mask = np.zeros((len(series), longest), bool)
    for k, s in enumerate(series):
        block[k, : len(s)] = s
        mask[k, : len(s)] = True
    return block, mask


def whitened_gram(columns, gap, counted, phi, q2):
    """Cross products (S, G, 10) and log-determinants (S, G) for S series and G filters.

    ``columns`` is (S, T, 4), ``gap`` (S, T) the time to the row before in time units,
    ``counted`` (S, T) marks rows that enter the sums (burn-in and padding do not).
    """
    s, t_max, _ = columns.shape
    g = len(phi)
    log_phi = np.log(phi)[None, :]
    gram = np.zeros((s, g, len(UPPER)))
    logdet = np.zeros((s, g))
    state = np.zeros((s, g, 4))
    var = np.broadcast_to(q2, (s, g)).copy()
    for t in range(t_max):
        if t:
            decay = np.exp(log_phi * gap[:, t, None])
            state *= decay[..., None]
            d2 = decay * decay
            var = d2 * var + q2 * (1 - d2)
        f = var + 1
        inno = columns[:, t, None, :] - state
        weight = counted[:, t, None] / f
        for k, (a, b) in enumerate(UPPER):
            gram[..., k] += weight * inno[..., a] * inno[..., b]
        logdet += counted[:, t, None] * np.log(f)
        gain = var / f
        state += gain[..., None] * inno
        var = gain
    return gram, logdet


def with_intercepts(gram, logdet, rho2):
    """Add a random subject intercept of variance ``rho2`` (a rank-one update), per rho.

    Shapes (..., G, 10) to (..., G, R, 10).  The first column of the cross product is the
    whitened intercept, so no new filter is needed.
    """
    rho2 = np.asarray(rho2)
    g = gram[..., None, :]
    shrink = rho2 / (1 + rho2 * g[..., 0])
    first = [g[..., 0], g[..., 1], g[..., 2], g[..., 3]]
    out = np.stack([g[..., k] - shrink * first[a] * first[b] for k, (a, b) in enumerate(UPPER)], axis=-1)
    return out, logdet[..., None] + np.log1p(rho2 * g[..., 0])


def rescale(gram, mi, si, mj, sj, my=0.0, sy=1.0):
    """Cross product after (xi - mi) / si, (xj - mj) / sj and (y - my) / sy."""
    g = [gram[..., k] for k in range(len(UPPER))]
    return np.stack(
        [
            g[0],
            (g[1] - mi * g[0]) / si,
            (g[2] - mj * g[0]) / sj,
            (g[3] - my * g[0]) / sy,
            (g[4] - 2 * mi * g[1] + mi * mi * g[0]) / si**2,
            (g[5] - mi * g[2] - mj * g[1] + mi * mj * g[0]) / (si * sj),
            (g[6] - mi * g[3] - my * g[1] + mi * my * g[0]) / (si * sy),
            (g[7] - 2 * mj * g[2] + mj * mj * g[0]) / sj**2,
            (g[8] - mj * g[3] - my * g[2] + mj * my * g[0]) / (sj * sy),
            (g[9] - 2 * my * g[3] + my * my * g[0]) / sy**2,
        ],
        axis=-1,
    )
