"""Posterior draws and sampler diagnostics made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The parameter names a draws table may carry.
DRAW_VARIABLES = ["r0", "a_ii", "a_ij", "sigma", "sd_ou", "phi", "sigma_ou", "lambda", "sigma_pred", "tau_r", "nu"]

KEYS = ["from", "to", "chain", "iter"]


def read_draws(df: DataFrame) -> DataFrame:
    """Long draws with known variables only; wide draws are unpivoted first."""
    if "variable" not in df.columns:
        known = [c for c in DRAW_VARIABLES if c in df.columns]
        df = df.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in known]).unpivot(
            KEYS, known, "variable", "value"
        )
    return df.filter(F.col("variable").isin(DRAW_VARIABLES)).select(*KEYS, "variable", F.col("value").cast("double"))


def read_sampler_diag(df: DataFrame) -> DataFrame:
    return df.select(
        *KEYS,
        F.col("divergent").cast("int").alias("divergent"),
        F.col("treedepth").cast("int").alias("treedepth"),
        F.col("energy").cast("double").alias("energy"),
    )
