"""Column helpers shared by every operator.  All of them stay inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True only for an ordinary number; null, NaN and infinities are all missing."""
    # NaN sorts above every number in Spark, so one comparison covers it.
    return F.coalesce(F.abs(col(c)) < F.lit(INF), F.lit(False))


def finite_or(c: Column | str, default) -> Column:
    c = col(c)
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(finite(c), c).otherwise(other)


def clamp(c: Column | str, low, high) -> Column:
    """Clamp that keeps null as null (``least``/``greatest`` would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, _lit(high)), _lit(low)))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def ratio(num: Column, den: Column) -> Column:
    """Null instead of an ANSI error when the denominator is zero or missing."""
    return F.try_divide(num, F.when(den != 0, den))


def corr_from_sums(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson correlation from additive sums; null on a constant series."""
    cov = sxy - sx * sy / n
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    r = ratio(cov, F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy)))
    return clamp(r, -1.0, 1.0)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Aggregate correlation that gives null, not an error, on a constant group."""
    x, y = col(x), col(y)
    return ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def partial_corr(rxy, rxz, ryz, floor: float = 1e-12) -> Column:
    """Correlation of x and y given z, from the three plain correlations."""
    left = F.greatest(1 - rxz * rxz, F.lit(floor))
    right = F.greatest(1 - ryz * ryz, F.lit(floor))
    return clamp((rxy - rxz * ryz) / F.sqrt(left * right), -1.0, 1.0)


def mix_weights(ratio_pair) -> list[float]:
    """Normalise mixing weights.  One number w means (w, 1 - w)."""
    values = [float(v) for v in (ratio_pair if isinstance(ratio_pair, (list, tuple)) else [ratio_pair])]
    if len(values) == 1:
        values = [values[0], 1.0 - values[0]]
    if any(not math.isfinite(v) or v < 0 for v in values) or sum(values) <= 0:
        raise ValueError("mixing weights must be finite, non-negative and not all zero")
    return [v / sum(values) for v in values]


def check_choice(name: str, value, choices) -> None:
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(map(str, choices))}; got {value!r}")
