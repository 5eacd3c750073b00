"""Compositions of two parts and the rest: zeros, closure, floors, log-ratios, caps.

Each function adds columns to rows that carry ``pi``, ``pj`` and ``pr`` (the shares of
part i, part j and the rest).  All are plain column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexflow.functions.scalars import check_choice, clamp, mix_weights

ZERO_MODES = ("minpos_subject", "minpos_time", "lib", "fixed")


def rest_share(lib, ci, cj) -> Column:
    """Share of everything else, from counts so that a true zero stays exactly zero."""
    return F.greatest(F.lit(0.0), (lib - ci - cj) / lib)


def triplet(df: DataFrame) -> DataFrame:
    """Shares of i, j and the rest from counts ``ci``, ``cj`` and ``lib``."""
    lib, ci, cj = F.col("lib"), F.col("ci"), F.col("cj")
    return df.withColumns({"pi": ci / lib, "pj": cj / lib, "pr": rest_share(lib, ci, cj)})


def positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def min_positive(base: str) -> Column:
    """Smallest positive part of one row; null when every part is zero."""
    check_choice("base", base, ("ij", "triplet"))
    parts = ["pi", "pj"] + (["pr"] if base == "triplet" else [])
    return F.least(*[positive(p) for p in parts])


def pseudo_count(mode: str, *, alpha=0.5, base="ij", lib_pseudo=0.5, fixed=1e-6, lib_rule="share", fallback=1e-8) -> Column:
    """The value that stands in for zeros.

    ``minpos_subject`` needs ``series_min``, the smallest positive part of the series.
    ``lib_rule`` is ``share`` (c / lib, at least 1e-12) or ``eps`` (c / lib, at least ``fixed``).
    """
    check_choice("zero_mode", mode, ZERO_MODES)
    if mode == "lib":
        share = F.lit(float(lib_pseudo)) / F.greatest(F.col("lib"), F.lit(1.0))
        return F.greatest(share, F.lit(1e-12 if lib_rule == "share" else float(fixed)))
    if mode == "fixed":
        return F.lit(float(fixed))
    smallest = F.col("series_min") if mode == "minpos_subject" else min_positive(base)
    return F.coalesce(F.lit(float(alpha)) * smallest, F.lit(float(fallback)))


def close_triplet(df: DataFrame, eps: Column, floor_frac: float = 1.0, floor_when: str = "after") -> DataFrame:
    """Replace zeros by ``eps``, close to one, floor the rest.

    ``floor_when="after"`` floors the closed rest and shrinks i and j so the sum stays
    one; ``"before"`` floors the open rest and then closes.  Adds ``eps_s`` (eps after
    closure) and ``floor_hit``.
    """
    check_choice("floor_when", floor_when, ("after", "before"))
    out = df.withColumn("_eps", eps)
    for part in ("pi", "pj", "pr"):
        out = out.withColumn(part, F.when(F.col(part) <= 0, F.col("_eps")).otherwise(F.col(part)))
    if floor_when == "before":
        floor = F.lit(float(floor_frac)) * F.col("_eps")
        out = out.withColumn("floor_hit", (F.col("pr") < floor).cast("int")).withColumn("pr", F.greatest("pr", floor))
    out = out.withColumn("_tot", F.col("pi") + F.col("pj") + F.col("pr"))
    out = out.withColumns({p: F.col(p) / F.col("_tot") for p in ("pi", "pj", "pr")}).withColumn(
        "eps_s", F.col("_eps") / F.col("_tot")
    )
    if floor_when == "after":
        floor = F.lit(float(floor_frac)) * F.col("eps_s")
        shrink = F.when(F.col("pr") < floor, (1 - floor) / (F.col("pi") + F.col("pj"))).otherwise(F.lit(1.0))
        out = out.withColumn("_shrink", shrink).withColumns(
            {
                "floor_hit": (F.col("pr") < floor).cast("int"),
                "pi": F.col("pi") * F.col("_shrink"),
                "pj": F.col("pj") * F.col("_shrink"),
                "pr": F.greatest(F.col("pr"), floor),
            }
        )
    return out.drop("_eps", "_tot", "_shrink")


def log_ratio(df: DataFrame) -> DataFrame:
    """Additive log-ratios of i and j against the rest."""
    return df.withColumns({"x": F.log("pi") - F.log("pr"), "y": F.log("pj") - F.log("pr")})


def log_ratio_eps(df: DataFrame, eps: float) -> DataFrame:
    """Log-ratios with a small amount added to every part."""
    e = F.lit(float(eps))
    rest = F.log(F.col("pr") + e)
    return df.withColumns({"x": F.log(F.col("pi") + e) - rest, "y": F.log(F.col("pj") + e) - rest})


def cap_bound(mode: str, value: float) -> Column | None:
    """Largest allowed log-ratio: none, fixed, or from the scaled eps of the row."""
    check_choice("cap_mode", mode, ("dynamic", "fixed", "none"))
    if mode == "none" or value == float("inf"):
        return None
    if mode == "fixed":
        return F.lit(float(value))
    e = F.col("eps_s")
    room = F.when(e < 0.5, F.log((1 - 2 * e) / e)).otherwise(F.lit(0.0))
    return F.least(F.lit(float(value)), F.greatest(F.lit(0.0), room))


def cap_log_ratio(df: DataFrame, mode: str = "dynamic", value: float = 12.0) -> DataFrame:
    """Winsorise ``x`` and ``y``; ``cap_hit`` counts the values moved by more than rounding."""
    bound = cap_bound(mode, value)
    if bound is None:
        return df.withColumn("cap_hit", F.lit(0))
    out = df.withColumn("_cap", bound)
    over = F.col("_cap") + F.lit(1e-9)
    hits = (F.abs("x") > over).cast("int") + (F.abs("y") > over).cast("int")
    return out.withColumn("cap_hit", hits).withColumns(
        {c: clamp(c, -F.col("_cap"), F.col("_cap")) for c in ("x", "y")}
    ).drop("_cap")


def mix_compositions(a: DataFrame, b: DataFrame, mix=(5, 5)) -> DataFrame:
    """Two closed panels on the same samples as one composition with fixed weights.

    Inputs and output: ``sample, taxon, ra``; taxa are keyed by (panel, taxon).
    """
    wa, wb = mix_weights(mix)
    left = a.select("sample", F.lit("a").alias("panel"), "taxon", (F.col("ra") * F.lit(wa)).alias("ra"))
    right = b.select("sample", F.lit("b").alias("panel"), "taxon", (F.col("ra") * F.lit(wb)).alias("ra"))
    return left.unionByName(right)
