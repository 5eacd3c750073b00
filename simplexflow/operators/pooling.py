"""Random-effects pooling of subject correlations for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexflow.functions import tails
from simplexflow.functions.scalars import check_choice, clamp, finite, ratio
from simplexflow.operators.pairs import PAIR
from simplexflow.plans.lineage import cut

VAR_METHODS = ("auto", "fisherz", "bonett", "fhp")


def fisher_effect(r: Column) -> Column:
    return F.atanh(clamp(r, -1 + 1e-12, 1 - 1e-12))


def effect_variance(r: Column, n: Column, var_method: str, method: str) -> Column:
    """Sampling variance of atanh(r); null when n is 3 or less."""
    check_choice("var_method", var_method, VAR_METHODS)
    used = variance_label(var_method, method)
    top = {"fisherz": F.lit(1.0), "bonett": 1 + r * r / 2, "fhp": F.lit(1.06)}[used]
    return F.when(n > 3, top / (n - 3))


def variance_label(var_method: str, method: str) -> str:
    """Pearson always uses fisherz; Spearman ``auto`` means bonett."""
    if method == "pearson":
        return "fisherz"
    return "bonett" if var_method == "auto" else var_method


def reml_tau2(same: DataFrame, by: list[str], tol: float = 1e-10, rounds: int = 2500, steps: int = 4) -> DataFrame:
    """``by, tau2``: the REML between-subject variance of every pair by joint Fisher scoring.

    ``same`` has effects of equal variance ``v`` by their number ``_m``, sum ``_sz`` and sum of squares ``_szz``.  A step joins the
    current values of all open pairs to these rows and takes six sums by a partial aggregate, so no pair's rows meet in one task.
    ``steps`` steps make one job; pairs that moved by less than ``tol`` in its last step are settled and leave.
    """
    m, sz, szz, v = (F.col(c) for c in ("_m", "_sz", "_szz", "v"))
    start = same.groupBy(*by).agg(F.sum(m).alias("_n"), F.sum(sz).alias("_z"), F.sum(szz).alias("_zz"), F.sum(m * v).alias("_v")).where("_n >= 2")
    spread = (F.col("_zz") - F.col("_z") * F.col("_z") / F.col("_n")) / (F.col("_n") - 1)
    open_ = start.select(*by, F.greatest(F.lit(0.0), spread - F.col("_v") / F.col("_n")).alias("tau2"))
    settled = []
    for turn in range(rounds):
        for _ in range(steps):
            w = 1 / (v + F.col("tau2"))
            sums = same.join(open_.select(*by, "tau2"), by).withColumn("_w", w).groupBy(*by, "tau2").agg(
                F.sum(m * F.col("_w")).alias("_a"), F.sum(sz * F.col("_w")).alias("_b"), F.sum(m * F.pow("_w", F.lit(2))).alias("_c"),
                F.sum(m * F.pow("_w", F.lit(3))).alias("_d"), F.sum(szz * F.pow("_w", F.lit(2))).alias("_e"), F.sum(sz * F.pow("_w", F.lit(2))).alias("_f"))
            mu, share = F.col("_b") / F.col("_a"), F.col("_c") / F.col("_a")
            excess = F.col("_e") - 2 * mu * F.col("_f") + mu * mu * F.col("_c") - (F.col("_a") - share)
            curve = F.col("_c") - 2 * F.col("_d") / F.col("_a") + share * share
            moved = F.greatest(F.lit(0.0), F.col("tau2") + F.coalesce(ratio(excess, curve), F.lit(0.0)))
            open_ = sums.select(*by, moved.alias("tau2"), F.abs(moved - F.col("tau2")).alias("_moved"))
        open_ = cut(open_)
        still = open_.where(F.col("_moved") >= tol)
        if turn == rounds - 1 or still.isEmpty():
            settled.append(open_)
            break
        settled.append(open_.where(F.col("_moved") < tol))
        open_ = still
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(*by, "tau2")


def pool_effects(effects, by=None, method="DL", knha=True, min_k=2, with_p=True, extra=None) -> DataFrame:
    """Pool rows ``by, z, v`` (one per subject) to one row per pair, by partial aggregates only.

    The between-subject variance follows from five sums.  What depends on it is then taken from sums
    per distinct variance, so no subject's row is moved to its pair.  ``extra`` maps names to
    further aggregates of the same rows, taken with the first sums.
    """
    check_choice("meta_method", method, ("DL", "REML"))
    by, extra = by or PAIR, extra or {}
    effects = cut(effects)
    use = finite("z") & finite("v") & (F.col("v") > 0)
    wt, z = F.when(use, 1 / F.col("v")), F.col("z")
    sums = effects.groupBy(*by).agg(
        F.count(wt).alias("k"), F.sum(wt).alias("_sw"), F.sum(wt * wt).alias("_sww"), F.sum(wt * z).alias("_swz"), F.sum(wt * z * z).alias("_swzz"),
        *[c.alias(name) for name, c in extra.items()],
    )
    q = F.greatest(F.lit(0.0), F.col("_swzz") - F.col("_swz") * F.col("_swz") / F.col("_sw"))
    sums = sums.withColumn("q_stat", F.when(F.col("k") > 0, q)).withColumn("_c", F.col("_sw") - F.col("_sww") / F.col("_sw"))
    same = effects.filter(use).groupBy(*by, "v").agg(F.count("*").alias("_m"), F.sum("z").alias("_sz"), F.sum(z * z).alias("_szz"))
    if method == "DL":
        tau2 = F.greatest(F.lit(0.0), ratio(F.col("q_stat") - (F.col("k") - 1), F.col("_c")))
        sums = sums.withColumn("tau2", F.coalesce(tau2, F.lit(0.0)))
    else:
        same = cut(same)
        sums = sums.join(reml_tau2(same, by), by, "left")
    star = 1 / (F.col("v") + F.col("tau2"))
    second = same.join(sums.select(*by, "tau2"), by).withColumn("_ws", star).groupBy(*by).agg(
        F.sum(F.col("_ws") * F.col("_m")).alias("_sws"), F.sum(F.col("_ws") * F.col("_sz")).alias("_swsz"), F.sum(F.col("_ws") * F.col("_szz")).alias("_swszz"))
    pooled = sums.join(second, by, "left").withColumn("z_pooled", F.col("_swsz") / F.col("_sws"))
    pooled = pooled.withColumn("_ss", F.greatest(F.lit(0.0), F.col("_swszz") - F.col("z_pooled") * F.col("_swsz")))
    df_ = F.col("k") - 1
    variance = ratio(F.col("_ss"), df_ * F.col("_sws")) if knha else 1 / F.col("_sws")
    typical = ratio(df_.cast("double"), F.col("_c"))
    ok = F.col("k") >= min_k
    out = pooled.select(
        *by,
        F.col("k").cast("long").alias("k"),
        F.when(ok, F.col("z_pooled")).alias("z_pooled"),
        F.when(ok, F.sqrt(variance)).alias("se"),
        F.when(ok, F.tanh("z_pooled")).alias("r_pooled"),
        F.when(ok, F.col("tau2")).alias("tau2"),
        F.when(ok, 100 * ratio(F.col("tau2"), typical + F.col("tau2"))).alias("i2"),
        F.when(ok, F.col("q_stat")).alias("q_stat"),
        *extra,
    )
    return _with_p_values(out, knha) if with_p else out


def _with_p_values(out: DataFrame, knha: bool) -> DataFrame:
    df_ = (F.col("k") - 1).cast("double")
    stat = ratio(F.col("z_pooled"), F.col("se"))
    tail = tails.t_two_sided_p(stat, df_) if knha else tails.normal_two_sided_p(stat)
    certain = F.when(F.col("z_pooled") == 0, 1.0).otherwise(0.0)
    p = F.when(F.col("se") == 0, certain).otherwise(tail)
    width = tails.t_quantile_975(df_) if knha else F.lit(tails.Z975)
    return out.withColumns(
        {"p": p, "q_stat_p": F.when(F.col("q_stat").isNotNull(), tails.chi2_upper_p("q_stat", df_)), "_wide": width}
    ).withColumns(
        {
            "ci_low": F.tanh(F.col("z_pooled") - F.col("_wide") * F.col("se")),
            "ci_high": F.tanh(F.col("z_pooled") + F.col("_wide") * F.col("se")),
        }
    ).drop("_wide")
