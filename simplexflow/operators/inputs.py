"""Rows for the directed regression: the rate of change of one part on two lagged parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from simplexflow.functions.scalars import check_choice, clamp, finite, ratio
from simplexflow.operators import compose as C
from simplexflow.operators import pairs as P

EDGE = ["from", "to"]
ROW = ["from", "to", "subject", "time", "y", "xi", "xj"]


def lag_gaps(chunked: DataFrame, lag: int) -> DataFrame:
    """Per chunked axis row: time to the row ``lag`` positions back, floored for stability.

    The floor is a quarter of the subject's median positive gap; a gap of zero or less
    is null.  A property of samples, so it is found once and not per pair.
    """
    w = W.partitionBy("subject", "chunk").orderBy("pos")
    spots = chunked.select("subject", "chunk", "pos", "group_time", "halo").distinct()  # samples that share a time are one position
    rows = spots.withColumn("_gap", F.col("group_time") - F.lag("group_time", lag).over(w))
    rows = rows.withColumn("step", F.col("group_time") - F.lag("group_time").over(w))
    usual = rows.filter(~F.col("halo") & (F.col("_gap") > 0)).groupBy("subject").agg(F.median("_gap").alias("_usual"))
    rows = rows.join(usual, "subject", "left")
    gap = F.when(F.col("_gap") > 0, F.greatest("_gap", F.lit(0.25) * F.col("_usual")))
    return chunked.join(rows.select("subject", "chunk", "pos", "step", gap.alias("dt")), ["subject", "chunk", "pos"])


def lagged_presence(cells: DataFrame, axis: DataFrame, lag: int) -> DataFrame:
    """Share of a part's lagged rows that are not zero, per (subject, taxon)."""
    spots = axis.select("sample", "pos", "n_groups")
    seen = cells.select("subject", "taxon", "sample", "ra").join(spots, "sample")
    counted = F.when((F.col("ra") > 0) & (F.col("pos") < F.col("n_groups") - lag), F.col("pos"))
    return seen.groupBy("subject", "taxon").agg(
        (F.count_distinct(counted) / F.greatest(F.max("n_groups") - lag, F.lit(1))).alias("nz"),
        F.min(F.when(F.col("ra") > 0, F.col("ra"))).alias("min_pos"),
    )


def log_ratio_rows(rows: DataFrame, profile, *, zero_mode="minpos_time", alpha=0.5, base="ij", eps_fixed=1e-6,
                   lib_pseudo=0.65, floor_frac=1.0, cap_mode="none", cap_value=8.0) -> DataFrame:
    """Add ``x`` and ``y`` (log-ratios) to pair rows that carry ``pi``, ``pj``, ``pr``."""
    if zero_mode == "minpos_subject":
        rows = rows.withColumn("_low", C.min_positive(base))
        rows = P.series_stats(rows, {"series_min": F.min("_low")}, profile).drop("_low")
    eps = C.pseudo_count(zero_mode, alpha=alpha, base=base, lib_pseudo=lib_pseudo, fixed=eps_fixed,
                         lib_rule="eps", fallback=eps_fixed)
    rows = rows.withColumns({"ra_i": F.col("pi"), "ra_j": F.col("pj")})
    rows = C.log_ratio(C.close_triplet(rows, eps, floor_frac, "before"))
    return C.cap_log_ratio(rows, cap_mode, cap_value)


def directed_rows(rows: DataFrame, lag: int = 1, transform: str = "alr", nz_min: float = 0.15) -> DataFrame:
    """Both directions of every pair row, in one pass: ``from`` acts on ``to``.

    ``y`` is the change of the target's log-ratio per unit time, ``xi`` the lagged target
    and ``xj`` the lagged partner.  A subject is left out of an edge when its partner is
    mostly absent.
    """
    check_choice("transform", transform, ("alr", "raw"))
    w = P.series_window("pos")
    back = {f"_{c}": F.lag(c, lag).over(w) for c in ("x", "y")}
    if transform == "raw":
        back.update({f"_{c}": F.lag(c, lag).over(w) for c in ("ra_i", "ra_j")})
    rows = rows.withColumns(back)
    pi, pj = ("_x", "_y") if transform == "alr" else ("_ra_i", "_ra_j")
    to_i = F.struct(
        F.col("j").alias("from"), F.col("i").alias("to"), ratio(F.col("x") - F.col("_x"), F.col("dt")).alias("v"),
        F.col(pi).alias("xi"), F.col(pj).alias("xj"), F.col("nz_j").alias("nz"),
    )
    to_j = F.struct(
        F.col("i").alias("from"), F.col("j").alias("to"), ratio(F.col("y") - F.col("_y"), F.col("dt")).alias("v"),
        F.col(pj).alias("xi"), F.col(pi).alias("xj"), F.col("nz_i").alias("nz"),
    )
    out = rows.select(*P.TILE, "pos", "halo", "step", F.col("group_time").alias("time"), *_extras(rows),
                      F.inline(F.array(to_i, to_j))).withColumnRenamed("v", "y")
    good = finite("y") & finite("xi") & finite("xj") & finite("time")
    return out.filter(good & (F.col("nz") >= nz_min)).drop("nz")


def _extras(rows: DataFrame) -> list[str]:
    return [c for c in ("folds",) if c in rows.columns]


def guard_edges(rows: DataFrame, min_pairs: int = 4, min_sd: float = 1e-12) -> DataFrame:
    """Edges with enough rows and with predictors that vary."""
    stats = rows.groupBy(*EDGE).agg(
        F.count("*").alias("_n"), F.stddev_samp("xi").alias("_si"), F.stddev_samp("xj").alias("_sj")
    )
    keep = stats.filter((F.col("_n") >= min_pairs) & (F.col("_si") >= min_sd) & (F.col("_sj") >= min_sd))
    return rows.join(keep.select(*EDGE), EDGE, "left_semi")


def zscore(df: DataFrame, by: list[str], cols: list[str], cap: float | None = 5.0) -> DataFrame:
    """Standardise within groups; a constant group has unit sd."""
    w = W.partitionBy(*by)
    out = df
    for c in cols:
        sd = F.stddev_samp(c).over(w)
        out = out.withColumn(f"_m_{c}", F.avg(c).over(w)).withColumn(f"_s_{c}", F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in cols}
    out = out.withColumns(z)
    if cap is not None:
        out = out.withColumns({c: clamp(c, -float(cap), float(cap)) for c in cols})
    return out.drop(*[f"_{k}_{c}" for c in cols for k in "ms"])


def scale_table(df: DataFrame, by: list[str], cols=("xi", "xj", "y")) -> DataFrame:
    """Mean and sd of each column per group: one small row per edge."""
    aggs = []
    for c in cols:
        sd = F.stddev_samp(c)
        aggs += [F.avg(c).alias(f"m_{c}"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias(f"s_{c}")]
    return df.groupBy(*by).agg(*aggs)


def apply_scale(df: DataFrame, scales: DataFrame, by: list[str], cols=("xi", "xj", "y")) -> DataFrame:
    """Standardise by supplied means and sds (global, external, or of a training set)."""
    out = df.join(scales, by)
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in cols}
    return out.withColumns(z).drop(*[f"{k}_{c}" for c in cols for k in "ms"])
