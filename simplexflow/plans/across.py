"""Directed regressions between the parts of two panels on shared samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexflow.functions.scalars import mix_weights
from simplexflow.operators import kfold as K
from simplexflow.operators import pairs as P
from simplexflow.operators import summary
from simplexflow.operators import timeaxis as X
from simplexflow.plans import fit as single
from simplexflow.plans.lineage import cut, panel_axis
from simplexflow.sources import panel as S


def keyed(panel: DataFrame, name: str) -> DataFrame:
    """Parts named ``panel|part`` so equal names in both panels stay apart."""
    return panel.withColumn("taxon", F.concat(F.lit(f"{name}|"), "taxon"))


def mixed_triplet(rows: DataFrame, wa: float, wb: float, smoothed: bool) -> DataFrame:
    """Shares of one part from each panel in the mixed composition, and the rest."""
    if smoothed:
        pi, pj = F.lit(wa) * F.col("share_i"), F.lit(wb) * F.col("share_j")
        rest = F.lit(wa) * (1 - F.col("share_i")) + F.lit(wb) * (1 - F.col("share_j"))
        return rows.withColumns({"pi": pi, "pj": pj, "pr": F.when(rest > 1e-12, rest).otherwise(F.lit(0.0))})
    li, lj = F.col("own_lib_i"), F.col("own_lib_j")
    rest = F.lit(wa) * (li - F.col("ci")) / li + F.lit(wb) * (lj - F.col("cj")) / lj
    return rows.withColumns(
        {"pi": F.lit(wa) * F.col("ci") / li, "pj": F.lit(wb) * F.col("cj") / lj, "pr": F.greatest(F.lit(0.0), rest)}
    )


def _rows(panel_a, panel_b, samples, taxa_a, taxa_b, mix, names, o: single.FitOptions, splits_wanted: bool):
    wa, wb = mix_weights(mix)
    a, b = S.align_panels(panel_a, panel_b)
    shared = samples.join(a.select("sample").distinct(), "sample", "left_semi")
    a, b = keyed(a, names[0]), keyed(b, names[1])
    axis_a = panel_axis(a, shared)
    axis_b = panel_axis(b, shared)
    profile = X.profile_axis(axis_a, o.chunk_rows)
    splits = cut(K.kfold_splits(axis_a, o.kfold_k, o.kfold_r, o.seed)) if splits_wanted else None
    smoothed = o.smooth and o.smooth_scale == "logra"
    sides = []
    for panel, axis, taxa, name in ((a, axis_a, taxa_a, names[0]), (b, axis_b, taxa_b, names[1])):
        wanted = None if taxa is None else keyed(taxa, name)
        kept = S.require_taxa(panel, wanted, 1)
        seats = single.chunked_axis(axis, o, profile, splits)
        dense = single.dense_shares(kept, axis, seats, profile, o)
        sides.append(dense.withColumn("own_lib", F.col("lib")))
    carry = ["nz", "own_lib"] + (["share"] if smoothed else [])
    rows = mixed_triplet(P.pair_rows(*sides, carry=carry, blocks=o.blocks), wa, wb, smoothed)
    return single.regression_rows(rows, profile, o), axis_a, profile, splits, (wa, wb)


def pair_inputs_across(panel_a, panel_b, samples, *, taxa_a=None, taxa_b=None, mix=(5, 5), names=("k1", "k2"),
                       guard: bool = True, **options) -> DataFrame:
    """Regression rows of every directed pair between the panels; parts are ``panel|part``."""
    o = single.FitOptions(**options)
    rows, *_ = _rows(panel_a, panel_b, samples, taxa_a, taxa_b, mix, names, o, False)
    rows = rows.filter(~F.col("halo")).select(*single.I.ROW)
    return single.I.guard_edges(rows, o.min_pairs) if guard else rows


def fit_pairs_across(panel_a: DataFrame, panel_b: DataFrame, samples: DataFrame, *, taxa_a=None, taxa_b=None, mix=(5, 5),
                     names=("k1", "k2"), builder: Callable[[DataFrame], DataFrame] | None = None,
                     **options) -> dict[str, DataFrame]:
    """Fit both directions between every part of panel a and every part of panel b.

    The bundle is that of ``fit_pairs`` with the panel of each end, plus a one-row ``meta``.
    """
    o = single.FitOptions(**options)
    rows, axis, profile, splits, (wa, wb) = _rows(
        panel_a, panel_b, samples, taxa_a, taxa_b, mix, names, o, o.compute_elpd)
    if builder is not None:
        rows = rows.transform(builder)
    out = summary.bundle(single.run_edges(rows, axis, profile, o), splits, o)
    for name, table in out.items():
        for end in ("from", "to"):
            if end in table.columns:
                table = table.withColumn(f"{end}_panel", F.split_part(F.col(end), F.lit("|"), F.lit(1)))
        out[name] = table
    spark = axis.sparkSession
    out["meta"] = spark.range(1).select(
        F.lit(wa).alias("weight_1"), F.lit(wb).alias("weight_2"), F.lit(names[0]).alias("name_1"),
        F.lit(names[1]).alias("name_2"), axis.agg(F.count("*")).scalar().alias("n_samples"),
    )
    return out
