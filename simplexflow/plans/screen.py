"""Screen every pair of parts for within-subject association."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexflow.functions.scalars import check_choice, finite
from simplexflow.operators import association as A
from simplexflow.operators import compose as C
from simplexflow.operators import multitest, pooling
from simplexflow.operators import pairs as P
from simplexflow.operators import timeaxis as X
from simplexflow.plans.lineage import cut, panel_axis
from simplexflow.sources import panel as S


@dataclass(frozen=True)
class ScreenOptions:
    transform: str = "alr"
    method: str = "pearson"
    min_n: int = 5
    min_k: int = 2
    meta_method: str = "DL"
    use_knha: bool = True
    prevalence_cut: float | None = None
    mean_ra_cut: float | None = None
    detrend: bool = False
    q_method: str = "BH"
    q_weight_by: str = "k"
    k_filter: int | None = None
    r_abs_min: float | None = None
    var_method: str = "auto"
    return_subjectwise: bool = False
    partial_rest: bool = False
    partial_method: str = "resid"
    zero_mode: str = "minpos_subject"
    zero_minpos_alpha: float = 0.5
    zero_minpos_base: str = "ij"
    zero_lib_pseudo: float = 0.5
    rest_floor_frac: float = 1.0
    cap_mode: str = "dynamic"
    cap_value: float = 12.0
    effn_method: str = "nw"
    effn_L: int | None = None
    merge_times: str | None = "median"
    merge_tol: float | None = None
    effn_phi_cap: float = 0.6
    effn_blend: float = 0.5
    effn_min_frac: float = 0.6
    acf_correction: bool = True
    cozero_check: bool = False
    cozero_tol: float = 0.5
    cozero_action: str = "exclude"
    cozero_min_subject_frac: float = 0.4
    nz_partner_min_frac: float = 0.15
    all_columns: bool = False
    blocks: int = P.BLOCKS
    chunk_rows: int = X.CHUNK_ROWS

    def __post_init__(self):
        check_choice("transform", self.transform, ("alr", "raw"))
        check_choice("method", self.method, ("pearson", "spearman"))
        check_choice("zero_mode", self.zero_mode, C.ZERO_MODES[:3])
        check_choice("partial_method", self.partial_method, ("resid", "matrix"))
        check_choice("cozero_action", self.cozero_action, ("exclude", "flag", "warn"))
        check_choice("merge_times", self.merge_times, ("median", "mean", None))
        check_choice("effn_method", self.effn_method, A.EFFN_METHODS)
        if self.partial_rest and self.transform == "alr":
            warnings.warn("partial_rest has no effect on log-ratios", stacklevel=3)


def subject_support(cells: DataFrame, axis: DataFrame, o: ScreenOptions) -> DataFrame:
    """(subject, taxon) members that pass the length, variance and non-zero guards.

    The guards do not depend on the partner, so they run on the panel before pairing.
    """
    sizes = axis.groupBy("subject").agg(F.count("*").alias("n_samples"), F.first("n_groups").alias("n_groups"))
    stats = P.support(cells).join(sizes, "subject").withColumns(P.zero_filled_moments(F.col("n_samples")))
    length = F.col("n_groups") if o.merge_times else F.col("n_samples")
    return stats.filter(
        (length >= o.min_n) & (F.col("var_ra") >= 1e-16) & (F.col("nz_share") >= o.nz_partner_min_frac)
    ).select("subject", "taxon", "min_pos", F.col("n_nonzero").alias("nz"))


def screen_rows(panel, samples, taxa=None, interesting=None, o: ScreenOptions | None = None):
    """One row per (pair, sample) with the two compared values ``x`` and ``y``.

    Returns the rows, the axis profile and the lags that the halo covers.
    """
    o = o or ScreenOptions()
    axis = panel_axis(panel, samples, o.merge_tol)
    profile = X.profile_axis(axis, o.chunk_rows)
    lags = A.longest_lag(profile.longest, o.effn_method, o.effn_L)
    if not profile.one_chunk and lags > o.chunk_rows:
        raise ValueError(f"{lags} lags reach over a chunk of {o.chunk_rows} times; raise chunk_rows")
    cells = S.cells_on_axis(panel, axis)
    total = axis.agg(F.count("*").alias("n"))
    kept = S.filter_taxa(cells, total, o.mean_ra_cut, o.prevalence_cut)
    if taxa is not None:
        kept = S.require_taxa(kept, taxa, 1)
    members = cut(subject_support(kept, axis, o))
    seats = X.assign_chunks(axis, o.chunk_rows, 0 if profile.one_chunk else lags)
    dense = P.dense_series(kept, seats, members)
    rows = P.pair_rows(dense, carry=["min_pos"], touching=interesting, blocks=P.blocks_for(panel, profile, o.blocks))
    rows = C.triplet(rows)
    rows = rows.withColumns(
        {
            "cozero": ((F.col("ci") == 0) & (F.col("cj") == 0)).cast("int"),
            "rest": F.col("pr"),
            "floor_hit": F.lit(0),
            "cap_hit": F.lit(0),
        }
    )
    if o.transform == "alr":
        if o.zero_mode == "minpos_subject":
            rows = rows.withColumn("series_min", F.least("min_pos_i", "min_pos_j"))
            if o.zero_minpos_base == "triplet":
                rows = P.series_stats(rows, {"_rest_min": F.min(C.positive("pr"))}, profile)
                rows = rows.withColumn("series_min", F.least("series_min", "_rest_min"))
        eps = C.pseudo_count(o.zero_mode, alpha=o.zero_minpos_alpha, base=o.zero_minpos_base, lib_pseudo=o.zero_lib_pseudo)
        rows = C.log_ratio(C.close_triplet(rows, eps, o.rest_floor_frac))
    else:
        rows = rows.withColumns({"x": F.col("pi"), "y": F.col("pj"), "eps_s": F.lit(0.0)})
    if o.merge_times and profile.has_repeats:
        rows = _merge(rows, o.merge_times)
    else:
        order = F.col("pos") if o.merge_times else F.row_number().over(P.series_window("time", "sample"))
        rows = rows.withColumn("pos", order).withColumn("members", F.lit(1))
    if o.transform == "alr":
        rows = C.cap_log_ratio(rows, o.cap_mode, o.cap_value)
    if o.detrend:
        line = {}
        for c in ("x", "y"):
            line[f"_b_{c}"], line[f"_a_{c}"] = F.regr_slope(c, "group_time"), F.regr_intercept(c, "group_time")
        line["_rows"] = F.count("*")
        rows = P.series_stats(rows, line, profile)
        for c in ("x", "y"):
            fit = F.when(F.col("_rows") >= 3, F.col(c) - F.col(f"_a_{c}") - F.col(f"_b_{c}") * F.col("group_time"))
            rows = rows.withColumn(c, F.coalesce(fit, c))
    return rows, profile, lags


def _merge(rows: DataFrame, how: str) -> DataFrame:
    """One row per time group.  The group is inside the tile, so nothing moves."""
    pick = F.median if how == "median" else F.avg
    return rows.groupBy(*P.TILE, "i", "j", "pos", "halo", "group_time").agg(
        *[pick(c).alias(c) for c in ("x", "y", "rest", "eps_s")],
        F.sum("cozero").alias("cozero"),
        F.sum("floor_hit").alias("floor_hit"),
        F.count("*").alias("members"),
    )


def subject_table(panel, samples, taxa=None, interesting=None, o: ScreenOptions | None = None) -> DataFrame:
    """One row per (pair, subject): correlation, lengths, co-zero share, safeguards."""
    o = o or ScreenOptions()
    rows, profile, lags = screen_rows(panel, samples, taxa, interesting, o)
    base = ["x", "y", "rest"] if (o.partial_rest and o.transform == "raw") else ["x", "y"]
    used = base
    ranked = o.method == "spearman" or (len(base) == 3 and o.partial_method == "matrix")
    if ranked:
        # Values equal to nine decimals are ties; log-ratios of equal shares differ in the last bits.
        rows = rows.withColumns({f"{c}_key": F.round(c, 9) for c in base})
        for c in [f"{b}_key" for b in base]:
            by = [*P.TILE, "i", "j"] if profile.one_chunk else P.SERIES
            rows = A.average_rank(rows, by, c, None if profile.one_chunk else X.SLICE_ROWS, None if profile.one_chunk else ~F.col("halo"))
        used = [f"{c}_key_rank" for c in base]
    # The effective length is that of the series that are correlated: ranks, and residuals where the rest is held fixed.
    series = used if o.method == "spearman" else base
    given = series[2] if len(base) == 3 and not (o.method == "spearman" and o.partial_method == "matrix") else None
    lag_cols = series[:2]
    # A series in one chunk is centred before its products are summed; chunks have only additive sums in common.
    whole = profile.one_chunk
    if o.acf_correction and whole:
        rows = P.series_stats(rows, A.series_line(lag_cols, given), profile).withColumns(A.centred(lag_cols, given))
        lag_cols, given = [f"_e_{c}" for c in lag_cols], None
    if o.acf_correction:
        rows = A.lagged_values(rows, series if given else lag_cols, lags)
    rows = rows.filter(~F.col("halo"))
    if whole:
        sums = (A.rank_sums if ranked else A.moment_sums)(used) | (A.centred_lag_sums(lag_cols, lags) if o.acf_correction else {})
    else:
        sums = A.moment_sums(list(dict.fromkeys([*used, *lag_cols, *([given] if given else [])])))
        if o.acf_correction:
            sums.update(A.lag_sums(lag_cols, lags, given))
    sums["_rest_var"] = F.var_samp("rest")
    for c in ("cozero", "floor_hit", "cap_hit", "members"):
        sums[f"_{c}"] = F.sum(c)
    table = rows.groupBy(*P.SERIES).agg(*[v.alias(k) for k, v in sums.items()])
    table = table.filter(F.col("n") >= o.min_n)
    if len(base) == 3:
        floor = 1e-12 if o.partial_method == "matrix" else 1e-300
        table = A.with_rest_correlation(table, *used, "_rest_var", floor)
    else:
        table = table.withColumn("r", A.plain_correlation(*used))
    n = F.col("n")
    if o.acf_correction:
        limit = min(o.effn_phi_cap, 0.95) if o.effn_method == "ar1" else 0.95
        table = A.with_autocorrelation(table, lag_cols, lags, given, A.rest_usable("_rest_var"), whole)
        table = table.withColumn("_raw_n", A.raw_effective_n(*lag_cols, lags, o.effn_method, o.effn_L, limit))
        raw, n_eff = F.col("_raw_n"), A.adjusted_n(n, F.col("_raw_n"), o.effn_blend, o.effn_min_frac)
    else:
        raw, n_eff = n.cast("double"), n.cast("double")
    table = table.select(
        *P.SERIES,
        "r",
        n.cast("long").alias("n"),
        raw.alias("n_eff_raw"),
        n_eff.alias("n_eff"),
        (F.col("_cozero") / F.col("_members")).alias("cozero_frac"),
        F.col("_floor_hit").cast("long").alias("floor_hits"),
        F.col("_cap_hit").cast("long").alias("cap_hits"),
    )
    if o.cozero_check and o.cozero_action == "exclude":
        table = table.filter(F.col("cozero_frac") < o.cozero_tol)
    if o.cozero_check and o.cozero_action != "exclude":
        table = table.withColumn("cozero_over", F.col("cozero_frac") >= o.cozero_tol)
    table = table.withColumn("z", pooling.fisher_effect(F.col("r")))
    return table.withColumn("v", pooling.effect_variance(F.col("r"), F.col("n_eff"), o.var_method, o.method))


def pair_summary(o: ScreenOptions) -> dict[str, Column]:
    """Length, co-zero and safeguard aggregates of each pair."""
    over = (F.col("cozero_frac") >= o.cozero_tol).cast("double")
    good = finite("z") & finite("v")
    return {
        "n_min": F.min("n").cast("double"),
        "n_median": F.median("n").cast("double"),
        "n_max": F.max("n").cast("double"),
        "n_effin_min": F.min("n_eff"),
        "n_effin_median": F.median("n_eff"),
        "n_effin_max": F.max("n_eff"),
        "cozero_median": F.median("cozero_frac"),
        "cozero_max": F.max("cozero_frac"),
        "cozero_flag": F.avg(over) >= F.lit(o.cozero_min_subject_frac),
        "floor_hits": F.sum("floor_hits"),
        "cap_hits": F.sum("cap_hits"),
        "n_dropped": F.sum(F.when(good, 0).otherwise(1)).cast("long"),
    }


def screen(panel: DataFrame, samples: DataFrame, *, taxa=None, interesting=None, **options) -> dict[str, DataFrame]:
    """Screen all pairs.  Tables: ``meta``, ``log`` and, when asked for, ``subjectwise``.

    A pair with too few usable subjects stays as a row of nulls.
    """
    o = ScreenOptions(**options)
    subjects = subject_table(panel, samples, taxa, interesting, o)
    if o.return_subjectwise:
        subjects = cut(subjects)
    pooled = pooling.pool_effects(
        subjects, method=o.meta_method, knha=o.use_knha, min_k=o.min_k, extra=pair_summary(o)
    )
    listed = P.all_pairs(listed_taxa(panel, samples, taxa, o), interesting)
    meta = listed.join(pooled, P.PAIR, "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")))
    meta = multitest.adjust(cut(meta), "p", o.q_method, o.q_weight_by)
    meta = meta.withColumn("var_method", F.lit(pooling.variance_label(o.var_method, o.method)))
    if o.k_filter is not None:
        meta = meta.filter(F.col("k") >= o.k_filter)
    if o.r_abs_min is not None:
        meta = meta.filter(finite("r_pooled") & (F.abs("r_pooled") >= o.r_abs_min))
    log = meta.select(*P.PAIR, "floor_hits", "cap_hits", "cozero_max", "n_dropped")
    out = {"meta": prune_columns(meta, o), "log": log}
    if o.return_subjectwise:
        out["subjectwise"] = subjects
    return out


def listed_taxa(panel, samples, taxa, o: ScreenOptions) -> DataFrame:
    """The parts left after the taxon filters."""
    cells = panel
    if o.mean_ra_cut is not None or o.prevalence_cut is not None:
        total = samples.filter(finite("time")).agg(F.count("*").alias("n"))
        cells = S.filter_taxa(S.with_library(panel), total, o.mean_ra_cut, o.prevalence_cut)
    if taxa is not None:
        cells = cells.join(taxa.select("taxon").distinct(), "taxon", "left_semi")
    return cells.select("taxon").distinct()


def prune_columns(meta: DataFrame, o: ScreenOptions) -> DataFrame:
    """Leave out columns that the options make meaningless."""
    if o.all_columns:
        return meta
    gone = []
    if not o.cozero_check:
        gone += ["cozero_median", "cozero_max", "cozero_flag"]
    if o.transform == "raw":
        gone += ["floor_hits", "cap_hits"]
    if not o.acf_correction:
        gone += ["n_effin_min", "n_effin_median", "n_effin_max"]
    return meta.drop(*gone)
