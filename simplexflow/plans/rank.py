"""Rank edges by sign certainty, diagnostics and model weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexflow.functions.scalars import check_choice, finite
from simplexflow.operators import draws as D
from simplexflow.operators import weights as B
from simplexflow.plans.lineage import cut

EDGE_COLUMNS = {"from", "to", "a_mean", "a_q2_5", "a_q97_5", "p_sign2"}
SELF_COLUMNS = {"pair_i", "pair_j", "taxon", "a_self_mean", "a_self_q2_5", "a_self_q97_5", "p_sign2_self"}
GRID_MASS = {"moderate": 0.5, "strict": 0.1, "scaled": 0.5}


def require_columns(df: DataFrame, needed: set[str], name: str) -> None:
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")


def with_gate(df: DataFrame, gate: str) -> DataFrame:
    """``diag_ok`` from sampler diagnostics when present, else from the posterior grid."""
    check_choice("gate", gate, tuple(GRID_MASS))
    if "rhat" in df.columns:
        return df.withColumn("diag_ok", D.diag_ok(gate))
    return df.withColumn("diag_ok", F.coalesce(F.col("grid_edge_mass") <= GRID_MASS[gate], F.lit(False)))


def with_sign(df: DataFrame, mean: str, p: str, alpha: float | None) -> DataFrame:
    out = df.withColumn("sign", D.sign_label(F.col(mean))).withColumn("bayes_fdr", D.local_false_sign(F.col(p)))
    if alpha is not None:
        out = out.withColumn("pass_bayes_fdr", finite("bayes_fdr") & (F.col("bayes_fdr") <= float(alpha)))
    return out


def rank_edges(bundle: dict[str, DataFrame], *, alpha: float | None = None, gate: str = "moderate", stacking: bool = True,
               per_row: bool = False, min_models: int = 2, min_subjects: int = 1, which: str = "cross",
               bootstrap: int = 1000) -> DataFrame:
    """Edges (``cross``) or self effects (``self``) with sign, gate, rate and weights, best first.

    ``bundle["diagnostics"]``, if given, holds sampler diagnostics by (from, to).
    """
    check_choice("which", which, ("cross", "self"))
    diag = bundle.get("diagnostics")
    if which == "self":
        own = bundle["self_effects"]
        require_columns(own, SELF_COLUMNS, "self_effects")
        if diag is not None:
            keyed = diag.select(F.least("from", "to").alias("pair_i"), F.greatest("from", "to").alias("pair_j"),
                                F.col("to").alias("taxon"), *[c for c in diag.columns if c not in ("from", "to")])
            own = own.join(keyed, ["pair_i", "pair_j", "taxon"], "left")
        own = with_sign(with_gate(own, gate), "a_self_mean", "p_sign2_self", alpha)
        none = F.lit(None).cast("double")
        out = own.withColumns({"w_pseudobma": none, "w_pseudobma_plus": none, "w_stacking": none})
        return out.orderBy(F.asc_nulls_last("bayes_fdr"), "pair_i", "pair_j", "taxon")
    edges = bundle["edges"]
    require_columns(edges, EDGE_COLUMNS, "edges")
    if diag is not None:
        edges = edges.join(diag, ["from", "to"], "left")
    edges = with_sign(with_gate(edges, gate), "a_mean", "p_sign2", alpha)
    points = bundle.get("pointwise")
    tables = {}
    if points is not None:
        # Each weight reads these two; uncut, every one of them would work out all diagnostics and scores again.
        edges = cut(edges)
        passing = cut(points.join(edges.filter("diag_ok").select("from", "to").distinct(), ["from", "to"], "left_semi"))
        rules = {"per_row": per_row, "min_models": min_models, "min_subjects": min_subjects}
        tables["w_pseudobma"] = B.pseudo_bma(passing, **rules)
        tables["w_pseudobma_plus"] = B.pseudo_bma(passing, bootstrap, **rules)
        if stacking:
            tables["w_stacking"] = B.stacking_weights(passing, **rules)
    for name in ("w_pseudobma", "w_pseudobma_plus", "w_stacking"):
        if name in tables:
            edges = edges.join(tables[name].withColumnRenamed("weight", name), ["from", "to"], "left")
        else:
            edges = edges.withColumn(name, F.lit(None).cast("double"))
    return edges.orderBy(F.asc_nulls_last("bayes_fdr"), "from", "to")
