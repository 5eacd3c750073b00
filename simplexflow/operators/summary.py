"""Turning fitted edges into result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexflow.operators.kfold import held_out_counts
from simplexflow.operators.posterior import SUMMARY

SCALE = ["mean_xi", "sd_xi", "mean_xj", "sd_xj", "mean_y", "sd_y"]


def sign_probability(p_pos):
    """Two-sided sign probability from P(> 0)."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.least(p_pos, 1 - p_pos)))


def edge_fits(raw: DataFrame) -> DataFrame:
    """One row per directed edge with named posterior values."""
    named = [F.col("edge_values")[k].alias(name) for k, name in enumerate(SUMMARY + SCALE)]
    fits = raw.filter("kind = 'fit'").select("from", "to", F.col("n_obs").alias("n_rows"), "nu", *named)
    return fits.withColumns({"p_sign2": sign_probability(F.col("a_p_pos")), "p_sign2_self": sign_probability(F.col("a_self_p_pos"))})


def subject_scores(raw: DataFrame, splits: DataFrame, method: str) -> DataFrame:
    """Mean held-out score of each (edge, subject) over repeats; null without a good fold."""
    held = raw.filter("kind = 'score'")
    per = held.groupBy("from", "to", "subject").agg(F.avg("elpd").alias("elpd"), F.max("n_obs").alias("n_obs"))
    out = per.join(held_out_counts(splits), "subject", "left")
    return out.select(
        "from", "to", "subject", "elpd", (F.col("elpd") / F.greatest("n_obs", F.lit(1))).alias("elpd_ppd"), "n_obs",
        "n_test", F.lit(method).alias("elpd_method"),
    )


def score_totals(pointwise: DataFrame) -> DataFrame:
    """Mean, sd and standard error of subject scores per edge."""
    return pointwise.groupBy("from", "to").agg(
        F.avg("elpd").alias("elpd_mean"),
        F.stddev_samp("elpd").alias("elpd_sd"),
        (F.stddev_samp("elpd") / F.sqrt(F.count("elpd"))).alias("elpd_se"),
        F.count("elpd").alias("n_subjects"),
    )


def fold_records(raw: DataFrame) -> DataFrame:
    """One row per (edge, repeat, fold): row counts, edge mass and whether it was fitted."""
    v = F.col("edge_values")
    ok = v[2].isNotNull() & ~F.isnan(v[2])
    return raw.filter("kind = 'fold'").select(
        "from", "to", "rep", "fold", "nu", v[0].cast("long").alias("n_train"), v[1].cast("long").alias("n_test"),
        F.when(ok, v[2]).alias("grid_edge_mass"), ok.alias("fold_ok"),
    )


def fold_counts(folds: DataFrame, nu_first: float | None = 5.0, nu_retry: float | None = 7.0) -> DataFrame:
    """Successful and failed folds per edge, and how many used each nu."""
    def used(nu):
        return F.sum(F.when(F.col("nu") == (nu or -1), 1).otherwise(0)).cast("long")

    return folds.groupBy("from", "to").agg(
        F.sum(F.col("fold_ok").cast("int")).cast("long").alias("folds_ok"),
        F.sum((~F.col("fold_ok")).cast("int")).cast("long").alias("folds_failed"),
        used(nu_first).alias("folds_nu_first"),
        used(nu_retry).alias("folds_nu_retry"),
    )


def pair_table(edges: DataFrame) -> DataFrame:
    """One wide row per unordered pair; pairs with only one fitted direction are left out."""
    keep = [c for c in edges.columns if c not in ("from", "to")]
    ij = edges.filter(F.col("from") < F.col("to")).select(
        F.col("from").alias("i"), F.col("to").alias("j"), *[F.col(c).alias(f"{c}_ij") for c in keep])
    ji = edges.filter(F.col("from") > F.col("to")).select(
        F.col("to").alias("i"), F.col("from").alias("j"), *[F.col(c).alias(f"{c}_ji") for c in keep])
    return ij.join(ji, ["i", "j"])


def complete_pairs(edges: DataFrame) -> DataFrame:
    """Edges whose opposite direction was fitted as well."""
    other = edges.select(F.col("to").alias("from"), F.col("from").alias("to"))
    return edges.join(other, ["from", "to"], "left_semi")


def self_effects(edges: DataFrame) -> DataFrame:
    """The target's own effect in each pair, keyed by pair and part."""
    return edges.select(
        F.least("from", "to").alias("pair_i"), F.greatest("from", "to").alias("pair_j"), F.col("to").alias("taxon"),
        *[F.col(c) for c in edges.columns if c.startswith("a_self_")], "p_sign2_self", "grid_edge_mass", "grid_points",
    )


def self_pointwise(pointwise: DataFrame) -> DataFrame:
    """Subject scores listed by pair and target part."""
    return pointwise.select(
        F.least("from", "to").alias("pair_i"), F.greatest("from", "to").alias("pair_j"), F.col("to").alias("taxon"),
        "subject", "elpd", "elpd_ppd", "n_obs", "n_test", "elpd_method",
    )


def nest_scores(pointwise: DataFrame) -> DataFrame:
    """Scores of an edge as one nested column (subjects per edge are bounded by the subject table)."""
    item = F.struct("subject", "elpd", "elpd_ppd", "n_obs", "n_test", "elpd_method")
    return pointwise.groupBy("from", "to").agg(F.array_sort(F.collect_list(item)).alias("payload"))


def unnest_scores(nested: DataFrame) -> DataFrame:
    """Nested scores back to one row per (edge, subject)."""
    return nested.select("from", "to", F.inline("payload"))


def bundle(raw: DataFrame, splits: DataFrame | None, o) -> dict[str, DataFrame]:
    """The five result tables of a fit."""
    edges = complete_pairs(edge_fits(raw))
    tables = {}
    if splits is not None:
        method = "kalman" if o.resid_mode == "ou" else "indep"
        pointwise = subject_scores(raw, splits, method).join(edges.select("from", "to"), ["from", "to"], "left_semi")
        folds = fold_records(raw)
        counts = fold_counts(folds, o.nu, o.nu_retry)
        edges = edges.join(score_totals(pointwise), ["from", "to"], "left").join(counts, ["from", "to"], "left")
        edges = edges.withColumns({"kfold_k": F.lit(o.kfold_k), "kfold_r": F.lit(o.kfold_r)})
        tables = {"pointwise": pointwise, "folds": folds}
    return {"pairs": pair_table(edges), "edges": edges, "self_effects": self_effects(edges), **tables}
