"""Fit the directed lagged regression for every ordered pair of parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexflow.functions.scalars import check_choice, clamp
from simplexflow.operators import gram as G
from simplexflow.operators import inputs as I
from simplexflow.operators import kfold as K
from simplexflow.operators import pairs as P
from simplexflow.operators import posterior as Q
from simplexflow.operators import smooth, summary
from simplexflow.operators import timeaxis as X
from simplexflow.plans.lineage import cut, panel_axis
from simplexflow.sources import panel as S

BURN_IN = 4096
SERIES_PER_STEP = 64
EDGE_ROWS_IN_TASK = 200_000
EDGE_SERIES_IN_TASK = 1_000
OUT = ("`from` string, `to` string, kind string, subject string, rep int, fold int, n_obs bigint, elpd double, "
       "nu double, edge_values array<double>")


@dataclass(frozen=True)
class FitOptions:
    transform: str = "alr"
    lag: int = 1
    resid_mode: str = "ou"
    use_student_t: bool = True
    nu_fix: float = 5.0
    nu_retry: float = 7.0
    edge_mass_limit: float = 0.5
    standardize_by_subject: bool = True
    nz_partner_min_frac: float = 0.15
    min_pairs: int = 4
    smooth: bool = True
    smooth_scale: str = "logra"
    eps: float = 1e-6
    spline_df: float | None = None
    spline_spar: float | None = None
    spline_cv: bool = True
    min_unique_times: int = 3
    zero_mode: str = "minpos_time"
    minpos_alpha: float = 0.5
    minpos_base: str = "ij"
    eps_fixed: float = 1e-6
    lib_eps_c: float = 0.65
    rest_floor_frac: float = 1.0
    cap_mode: str = "none"
    alr_cap: float = float("inf")
    compute_elpd: bool = True
    rank1: bool = True
    kfold_k: int = 5
    kfold_r: int = 3
    seed: int = 1234
    n_phi: int = 12
    n_q: int = 12
    n_rho: int = 5
    blocks: int = P.BLOCKS
    chunk_rows: int = X.CHUNK_ROWS
    task_rows: int = EDGE_ROWS_IN_TASK
    task_series: int = EDGE_SERIES_IN_TASK

    def __post_init__(self):
        check_choice("transform", self.transform, ("alr", "raw"))
        check_choice("resid_mode", self.resid_mode, ("ou", "wn"))
        check_choice("smooth_scale", self.smooth_scale, ("logra", "alr"))

    @property
    def grid(self) -> G.Grid:
        return G.Grid.default(self.n_phi, self.n_q, self.n_rho, self.resid_mode == "wn")

    @property
    def nu(self) -> float | None:
        return self.nu_fix if self.use_student_t else None


def chunked_axis(axis: DataFrame, o: FitOptions, profile: X.AxisProfile, splits: DataFrame | None) -> DataFrame:
    """Axis with chunks, lagged gaps and the fold list of each subject."""
    if splits is not None:
        axis = axis.join(K.fold_lists(splits), "subject", "left")
    halo = 0 if profile.one_chunk else min(o.chunk_rows, BURN_IN + o.lag)
    return cut(I.lag_gaps(X.assign_chunks(axis, o.chunk_rows, halo), o.lag))


def dense_shares(panel: DataFrame, axis: DataFrame, seats: DataFrame, profile: X.AxisProfile, o: FitOptions) -> DataFrame:
    """Dense (sample, part) rows with counts, and smoothed shares when asked for."""
    cells = S.cells_on_axis(panel, axis)
    every = S.grid_join(axis.select("subject").distinct(), panel.select("taxon").distinct(), "taxon")
    members = every.join(I.lagged_presence(cells, axis, o.lag), ["subject", "taxon"], "left")
    members = cut(members.select("subject", "taxon", F.coalesce("nz", F.lit(0.0)).alias("nz")))
    dense = P.dense_series(cells, seats, members)
    if profile.has_repeats:
        means = {"lib": F.avg("lib"), "count": F.avg("count"), "sample": F.min("sample")}
        keep = [c for c in dense.columns if c not in ("sample", "taxon", "time", "lib", "count", *P.TILE[:2], "pos")]
        dense = dense.groupBy("subject", "chunk", "pos", "taxon").agg(
            *[F.first(c).alias(c) for c in keep], *[v.alias(k) for k, v in means.items()]
        )
    if o.smooth and o.smooth_scale == "logra":
        dense = dense.withColumn("ra", F.col("count") / F.col("lib"))
        smoothed = smooth.smooth_shares(
            dense, ["subject", "chunk", "taxon"], "group_time", "ra", o.eps, "share", spline_df=o.spline_df,
            spar=o.spline_spar, cv=o.spline_cv, min_unique=o.min_unique_times,
        )
        dense = cut(smoothed.drop("edf", "ra"))
    return dense


def open_triplet(rows: DataFrame, smoothed: bool) -> DataFrame:
    """Shares of a pair row, from counts or from smoothed shares."""
    if not smoothed:
        lib, ci, cj = F.col("lib"), F.col("ci"), F.col("cj")
        rest = F.greatest(F.lit(0.0), (lib - ci - cj) / lib)
        return rows.withColumns({"pi": ci / lib, "pj": cj / lib, "pr": rest})
    rest = 1 - F.col("share_i") - F.col("share_j")
    rest = F.when(rest > 1e-12, rest).otherwise(F.lit(0.0))
    return rows.withColumns({"pi": F.col("share_i"), "pj": F.col("share_j"), "pr": rest})


def regression_rows(pair_rows: DataFrame, profile: X.AxisProfile, o: FitOptions) -> DataFrame:
    """Directed regression rows from pair rows with an open triplet."""
    rows = I.log_ratio_rows(
        pair_rows, profile, zero_mode=o.zero_mode, alpha=o.minpos_alpha, base=o.minpos_base, eps_fixed=o.eps_fixed,
        lib_pseudo=o.lib_eps_c, floor_frac=o.rest_floor_frac,
        cap_mode="fixed" if o.cap_mode == "none" and o.alr_cap != float("inf") else o.cap_mode,
        cap_value=8.0 if o.cap_mode == "dynamic" and o.alr_cap == float("inf") else o.alr_cap,
    )
    if o.smooth and o.smooth_scale == "alr":
        for c in ("x", "y"):
            rows = smooth.smooth_series(
                rows, [*P.TILE, "i", "j"], "group_time", c, f"_{c}s", spline_df=o.spline_df, spar=o.spline_spar,
                cv=o.spline_cv, min_unique=o.min_unique_times, together=True,
            ).withColumn(c, F.col(f"_{c}s")).drop(f"_{c}s", "edf")
    out = I.directed_rows(rows, o.lag, o.transform, o.nz_partner_min_frac)
    if o.standardize_by_subject and not o.compute_elpd:
        out = _subject_scores(out, profile)
    return out


def _subject_scores(rows: DataFrame, profile: X.AxisProfile) -> DataFrame:
    """z scores by subject; subjects in several chunks take mean and deviation from sums over their own rows, without halos."""
    cols = ["xi", "xj", "y"]
    if profile.one_chunk:
        return I.zscore(rows, [*P.TILE, "from", "to"], cols)
    by = ["from", "to", "subject"]
    scaled = I.apply_scale(rows, I.scale_table(rows.filter(~F.col("halo")), by, cols), by, cols)
    return scaled.withColumns({c: clamp(c, -5.0, 5.0) for c in cols}).select(*rows.columns)


def pair_inputs(panel: DataFrame, samples: DataFrame, *, guard: bool = True, **options) -> DataFrame:
    """The regression rows of every directed pair: ``from, to, subject, time, y, xi, xj``."""
    o = FitOptions(**options)
    axis = panel_axis(panel, samples)
    profile = X.profile_axis(axis, o.chunk_rows)
    seats = chunked_axis(axis, o, profile, None)
    rows = _panel_rows(panel, axis, seats, profile, o).filter(~F.col("halo")).select(*I.ROW)
    return I.guard_edges(rows, o.min_pairs) if guard else rows


def _panel_rows(panel, axis, seats, profile, o: FitOptions) -> DataFrame:
    smoothed = o.smooth and o.smooth_scale == "logra"
    dense = dense_shares(panel, axis, seats, profile, o)
    rows = P.pair_rows(dense, carry=["nz"] + (["share"] if smoothed else []), blocks=P.blocks_for(panel, profile, o.blocks))
    return regression_rows(open_triplet(rows, smoothed), profile, o)


def series_arrays(rows: DataFrame) -> DataFrame:
    """One row per (edge, subject, chunk) with its columns as arrays in time order."""
    folds = F.first("folds") if "folds" in rows.columns else F.lit(None).cast("array<int>")
    counted = F.when(F.col("halo"), F.lit(0.0)).otherwise(F.lit(1.0))
    packed = F.array_sort(F.collect_list(F.struct("pos", "step", counted.alias("use"), "xi", "xj", "y")))
    out = rows.groupBy(*P.TILE, "from", "to").agg(packed.alias("_s"), folds.alias("folds"))
    return out.select("from", "to", "subject", "chunk", "folds", *[F.col(f"_s.{c}").alias(c) for c in ("step", "use", "xi", "xj", "y")])


@dataclass
class EdgeSums:
    """Additive totals of an edge, overall and per (repeat, fold)."""

    grid: G.Grid
    gram: dict = field(default_factory=dict)
    logdet: dict = field(default_factory=dict)
    moments: dict = field(default_factory=dict)

    def add(self, keys, gram, logdet, moments):
        for key in keys:
            if key in self.gram:
                self.gram[key] += gram
                self.logdet[key] += logdet
                self.moments[key] += moments
            else:
                self.gram[key], self.logdet[key], self.moments[key] = gram.copy(), logdet.copy(), moments.copy()


def series_blocks(frames: Iterator[pd.DataFrame], grid: G.Grid, unit: float):
    """Cross products of each series, a few dozen series per numpy step."""
    phi, q = grid.points
    for pdf in frames:
        for start in range(0, len(pdf), SERIES_PER_STEP):
            part = pdf.iloc[start : start + SERIES_PER_STEP]
            raw = [np.column_stack([np.asarray(r, float) for r in cols])
                   for cols in zip(part["step"], part["use"], part["xi"], part["xj"], part["y"])]
            block, mask = G.pad(raw)
            gap = np.nan_to_num(block[..., 0]) / unit
            use = block[..., 1] * mask
            columns = np.concatenate([np.ones_like(block[..., :1]), block[..., 2:5]], axis=-1)
            gram, logdet = G.whitened_gram(columns, np.maximum(gap, 1e-6), use, phi, q**2)
            values = [block[..., k] for k in (2, 3, 4)]
            moments = np.stack([use.sum(1), *(np.sum(use * c, 1) for c in (*values, *(v * v for v in values)))], axis=1)
            folds = [None if f is None else [int(v) for v in f] for f in part["folds"]]
            yield from zip(part["subject"], folds, gram, logdet, moments)


def by_subject(blocks, long_subjects: bool):
    """Join the chunks of a subject.  Without long subjects each block is one subject."""
    if not long_subjects:
        yield from blocks
        return
    held = {}
    for subject, folds, gram, logdet, moments in blocks:
        if subject in held:
            _, g, d, m = held[subject]
            held[subject] = (folds, g + gram, d + logdet, m + moments)
        else:
            held[subject] = (folds, gram, logdet, moments)
    for subject, (folds, gram, logdet, moments) in held.items():
        yield subject, folds, gram, logdet, moments


def scales(moments, o: FitOptions):
    """Means and sds of xi, xj and y from sums; a constant column has unit sd.

    With folds the scale is that of the training rows; otherwise rows are scaled by subject before
    they come here, or not at all.
    """
    if not o.compute_elpd:
        return [0.0, 1.0] * 3
    n, out = moments[0], []
    for s, ss in zip(moments[1:4], moments[4:7]):
        var = max((ss - s * s / n) / max(n - 1, 1), 0.0)
        out += [s / n, np.sqrt(var) if var > 1e-24 else 1.0]
    return out


def spread_ok(moments, least=1e-12) -> bool:
    n = moments[0]
    return all(max((ss - s * s / n) / max(n - 1, 1), 0.0) >= least**2 for s, ss in zip(moments[1:3], moments[4:6]))


def fit_totals(sums: EdgeSums, key, o: FitOptions, nu):
    """Posterior of the whole edge (``key`` None) or of everything outside one fold."""
    gram, logdet, moments = sums.gram[None], sums.logdet[None], sums.moments[None]
    if key is not None:
        gram, logdet, moments = gram - sums.gram[key], logdet - sums.logdet[key], moments - sums.moments[key]
    if moments[0] < o.min_pairs or not spread_ok(moments):
        return None, None
    scale = scales(moments, o)
    return Q.fit_grid(G.rescale(gram, *scale), logdet, moments[0], sums.grid, nu), scale


def fit_with_retry(sums: EdgeSums, keys, o: FitOptions):
    """Main and fold fits; all are redone once with the wider noise law if any is poor."""
    for nu in (o.nu, o.nu_retry) if o.use_student_t and o.nu_retry else (o.nu,):
        fits = {key: fit_totals(sums, key, o, nu) for key in keys}
        poor = any(p is not None and p.edge_mass > o.edge_mass_limit for p, _ in fits.values())
        if not poor:
            break
    return fits, nu


def score_rows(fits, subject, folds, gram, logdet, n, o: FitOptions, rho2):
    """Held-out score of one subject for each repeat."""
    rows = []
    for rep, fold in enumerate(folds or [], start=1):
        post, scale = fits.get((rep, fold), (None, None))
        if post is None or n == 0:
            continue
        if o.rank1:
            own, det = G.with_intercepts(G.rescale(gram, *scale), logdet, rho2)
        else:
            own, det = G.rescale(gram, *scale)[:, None, :], logdet[:, None]
            own = np.broadcast_to(own, (*own.shape[:1], len(rho2), own.shape[2]))
            det = np.broadcast_to(det, own.shape[:2])
        rows.append((subject, rep, fold, int(n), Q.held_out_score(post, own, det, n)))
    return rows


def edge_job(o: FitOptions, unit: float, long_subjects: bool, one_pass: bool):
    """The grouped job of one edge; series arrive batch by batch and are only summed.

    With ``one_pass`` the caller has shown that an edge is small, and the scores are made
    in the same call.  Otherwise the fold sums are returned for a second job.
    """
    grid = o.grid
    rho2 = np.array(grid.rho) ** 2

    def job(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, kept = EdgeSums(grid), []
        for subject, folds, gram, logdet, moments in by_subject(series_blocks(frames, grid, unit), long_subjects):
            full, det = G.with_intercepts(gram, logdet, rho2)
            keys = [None] + [(r, f) for r, f in enumerate(folds or [], start=1)]
            sums.add(keys, full, det, moments)
            if one_pass and folds:
                kept.append((subject, folds, gram, logdet, moments[0]))
        if None not in sums.gram:
            return
        keys = list(sums.gram)
        fits, nu = fit_with_retry(sums, keys, o)
        post, scale = fits[None]
        if post is None:
            return
        n = int(sums.moments[None][0])
        values = Q.summarise(post, grid, nu, unit) + list(scale)
        rows = [(*key, "fit", None, None, None, n, None, nu, values)]
        for rep, fold in [k for k in keys if k is not None]:
            part, _ = fits[(rep, fold)]
            n_test = int(sums.moments[(rep, fold)][0])
            info = [float(n - n_test), float(n_test), np.nan if part is None else part.edge_mass]
            rows.append((*key, "fold", None, rep, fold, n_test, None, nu, info))
            if not one_pass and part is not None:
                whole = np.concatenate([v.ravel() for v in (
                    sums.gram[None] - sums.gram[(rep, fold)], sums.logdet[None] - sums.logdet[(rep, fold)],
                    sums.moments[None] - sums.moments[(rep, fold)])])
                rows.append((*key, "train", None, rep, fold, n_test, None, nu, whole))
        for subject, folds, gram, logdet, n_own in kept:
            for s, rep, fold, m, elpd in score_rows(fits, subject, folds, gram, logdet, n_own, o, rho2):
                rows.append((*key, "score", s, rep, fold, m, elpd, nu, None))
        yield pd.DataFrame(rows, columns=[c.split()[0].strip("`") for c in OUT.split(", ")])

    return job


def score_job(o: FitOptions, unit: float, long_subjects: bool):
    """Second pass for large edges: one block of held-out subjects against the fold sums."""
    grid = o.grid
    rho2 = np.array(grid.rho) ** 2
    cells, r = len(grid.points[0]), len(rho2)

    def job(key: tuple, series: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        fits = {}
        for rep, fold, nu, whole in zip(train["rep"], train["fold"], train["nu"], train["edge_values"]):
            whole = np.asarray(whole, float)
            cut_a, cut_b = cells * r * 10, cells * r * 11
            moments = whole[cut_b:]
            scale = scales(moments, o)
            gram = G.rescale(whole[:cut_a].reshape(cells, r, 10), *scale)
            nu = None if pd.isna(nu) else nu
            fits[(rep, fold)] = (Q.fit_grid(gram, whole[cut_a:cut_b].reshape(cells, r), moments[0], grid, nu), scale)
        rows = []
        nu = None if len(train) == 0 else train["nu"].iloc[0]
        for subject, folds, gram, logdet, moments in by_subject(series_blocks([series], grid, unit), long_subjects):
            for s, rep, fold, m, elpd in score_rows(fits, subject, folds, gram, logdet, moments[0], o, rho2):
                rows.append((key[0], key[1], "score", s, rep, fold, m, elpd, nu, None))
        return pd.DataFrame(rows, columns=[c.split()[0].strip("`") for c in OUT.split(", ")])

    return job


def run_edges(rows: DataFrame, axis: DataFrame, profile: X.AxisProfile, o: FitOptions, subject_block: int = 64) -> DataFrame:
    """All edges: fits, fold records and held-out scores in one table.

    No edge has more rows than the axis has samples, nor more series than it has
    subjects.  If that bound is small, one call does everything; otherwise sums are
    streamed and held-out subjects are scored block by block in a second job.
    """
    facts = axis.agg(F.count("*").alias("n"), F.count_distinct("subject").alias("s")).first()
    step = axis.groupBy("subject").agg(((F.max("group_time") - F.min("group_time"))).alias("span"),
                                       (F.max("n_groups") - 1).alias("gaps"))
    span = step.agg(F.sum("span").alias("span"), F.sum("gaps").alias("gaps")).first()
    unit = float(span["span"] / span["gaps"]) if span["gaps"] else 1.0
    one_pass = facts["n"] <= o.task_rows and facts["s"] <= o.task_series
    long_subjects = not profile.one_chunk
    series = P.spread(series_arrays(rows), "from", "to")
    if one_pass or not o.compute_elpd:
        return cut(series.groupBy("from", "to").applyInPandas(edge_job(o, unit, long_subjects, one_pass), OUT))
    series = cut(series)
    first = cut(series.groupBy("from", "to").applyInPandas(edge_job(o, unit, long_subjects, False), OUT))
    many = int(facts["s"] // subject_block) + 1
    block = F.pmod(F.xxhash64("subject"), F.lit(many)).alias("block")
    held = series.select("*", block).groupBy("from", "to", "block")
    train = first.filter("kind = 'train'").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    scores = held.cogroup(train.withColumn("block", F.col("block").cast("bigint")).groupBy("from", "to", "block"))
    scored = scores.applyInPandas(score_job(o, unit, long_subjects), OUT)
    return cut(first.filter("kind <> 'train'").unionByName(scored))


def fit_pairs(panel: DataFrame, samples: DataFrame, *, taxa: DataFrame | None = None,
              builder: Callable[[DataFrame], DataFrame] | None = None, **options) -> dict[str, DataFrame]:
    """Fit every directed pair of one panel.

    ``builder`` replaces the rule that turns directed regression rows into model rows.
    Tables: ``pairs``, ``edges``, ``self_effects``, ``pointwise``, ``folds``.  Response and predictors are
    standardised together (over the training rows with folds, else by subject unless
    ``standardize_by_subject`` is off), so coefficients and scores are in units of sds and do not
    depend on the clock's unit; only without any scaling are they in the units of the rows.
    """
    o = FitOptions(**options)
    panel = S.require_taxa(panel, taxa, 2)
    axis = panel_axis(panel, samples)
    profile = X.profile_axis(axis, o.chunk_rows)
    splits = cut(K.kfold_splits(axis, o.kfold_k, o.kfold_r, o.seed)) if o.compute_elpd else None
    seats = chunked_axis(axis, o, profile, splits)
    rows = _panel_rows(panel, axis, seats, profile, o)
    if builder is not None:
        rows = rows.transform(builder)
    return summary.bundle(run_edges(rows, axis, profile, o), splits, o)
