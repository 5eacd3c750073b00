"""Model weights over the partners of each target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from simplexflow.functions.scalars import finite
from simplexflow.plans.lineage import cut

CELLS_IN_TASK = 2_000_000


def score_column(per_row: bool = False) -> Column:
    """Total score, or the per-row score times the rows it was made from."""
    return F.col("elpd_ppd") * F.col("n_obs") if per_row else F.col("elpd")


def common_subjects(pointwise: DataFrame, per_row=False, min_models: int = 2, min_subjects: int = 1) -> DataFrame:
    """Scores ``to, from, subject, s`` of subjects that every model of the target scored.

    Targets with fewer models or common subjects than asked are left out.
    """
    rows = pointwise.select("to", "from", "subject", score_column(per_row).alias("s"))
    models = rows.select("to", "from").distinct().groupBy("to").agg(F.count("*").alias("_m"))
    good = rows.filter(finite("s"))
    full = good.groupBy("to", "subject").agg(F.count("*").alias("_c")).join(models, "to")
    full = full.filter((F.col("_c") == F.col("_m")) & (F.col("_m") >= min_models)).select("to", "subject")
    enough = full.groupBy("to").agg(F.count("*").alias("_s")).filter(F.col("_s") >= min_subjects).select("to")
    return good.join(full, ["to", "subject"], "left_semi").join(enough, "to", "left_semi")


def softmax(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """Softmax over a group (the models of one target), guarded against overflow."""
    w = W.partitionBy(*by)
    e = F.exp(F.col(column) - F.max(column).over(w))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def pseudo_bma(pointwise: DataFrame, bootstrap: int = 0, seed: int = 1234, per_row=False, min_models=2,
               min_subjects=1) -> DataFrame:
    """Pseudo-BMA weights per target; with ``bootstrap`` the Bayesian-bootstrap form.

    Bootstrap weights are exponentials from a hash of (seed, replicate, subject), so they
    do not depend on partitioning.
    """
    scores = common_subjects(pointwise, per_row, min_models, min_subjects)
    if not bootstrap:
        sums = scores.groupBy("to", "from").agg(F.sum("s").alias("_z"))
        return softmax(sums, ["to"], "_z", "weight").select("to", "from", "weight")
    reps = scores.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(int(bootstrap)))))
    bits = F.pmod(F.xxhash64(F.lit(int(seed)), "_b", "subject"), F.lit(1 << 53)).cast("double")
    reps = reps.withColumn("_w", -F.log((bits + 0.5) / F.lit(float(1 << 53))))
    sums = reps.groupBy("to", "from", "_b").agg(
        F.sum(F.col("_w") * F.col("s")).alias("_ws"), F.sum("_w").alias("_sw"), F.count("*").alias("_n")
    )
    sums = sums.withColumn("_z", F.col("_n") * F.col("_ws") / F.col("_sw"))
    return softmax(sums, ["to", "_b"], "_z", "_p").groupBy("to", "from").agg(F.avg("_p").alias("weight"))


def stack(log_scores: np.ndarray, steps: int = 5000, tol: float = 1e-10) -> np.ndarray:
    """Weights on the simplex that maximise the mean log mixture score (subjects x models).

    The multiplicative update never lowers the objective.  A tiny fixed offset separates
    models with the same scores.
    """
    n, k = log_scores.shape
    offset = np.where(np.ptp(log_scores, axis=0) == 0, 1e-12 * np.arange(1, k + 1), 0.0)
    p = np.exp(log_scores + offset - log_scores.max(axis=1, keepdims=True))
    w = np.full(k, 1.0 / k)
    for _ in range(steps):
        new = w * (p / (p @ w)[:, None]).mean(axis=0)
        if np.abs(new - w).max() < tol:
            return new / new.sum()
        w = new
    return w / w.sum()


def stacking_weights(pointwise: DataFrame, per_row=False, min_models=2, min_subjects=1,
                     task_cells: int = CELLS_IN_TASK, steps: int = 5000, tol: float = 1e-10) -> DataFrame:
    """Stacking weights per target.

    Targets whose score matrix has at most ``task_cells`` cells are solved one per group.
    Larger ones take the same steps as Spark aggregates, one pass per step, and stop by the same rule,
    so the size decides where a target is solved and not what comes out.
    """
    scores = cut(common_subjects(pointwise, per_row, min_models, min_subjects))
    sizes = scores.groupBy("to").agg(F.count("*").alias("_cells"))
    small = scores.join(sizes.filter(F.col("_cells") <= task_cells), "to", "left_semi")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="subject", columns="from", values="s").sort_index(axis=1)
        w = stack(table.to_numpy(float), steps, tol)
        return pd.DataFrame({"to": pdf["to"].iloc[0], "from": table.columns.to_list(), "weight": w})

    out = small.groupBy("to").applyInPandas(solve, "`to` string, `from` string, weight double")
    large = sizes.filter(F.col("_cells") > task_cells).select("to")
    if large.limit(1).count() == 0:
        return out
    return out.unionByName(stack_by_passes(scores.join(large, "to", "left_semi"), steps, tol))


def stack_by_passes(scores: DataFrame, steps: int, tol: float) -> DataFrame:
    """The steps of ``stack`` on distributed scores; a target leaves when none of its weights moves by ``tol``.

    Each step reads the scores once and ends in one small row per model, which is cut
    from its lineage so that plans do not grow.
    """
    top = F.max("s").over(W.partitionBy("to", "subject"))
    models = scores.groupBy("to", "from").agg((F.max("s") == F.min("s")).alias("_flat"))
    models = models.withColumn("_place", F.row_number().over(W.partitionBy("to").orderBy("from")))
    w = cut(models.select("to", "from", F.when(F.col("_flat"), F.lit(1e-12) * F.col("_place")).otherwise(F.lit(0.0)).alias("_offset"),
                          (1 / F.count("*").over(W.partitionBy("to"))).alias("weight")))
    p = scores.withColumn("_top", top).join(w, ["to", "from"])
    p = cut(p.select("to", "from", "subject", F.exp(F.col("s") + F.col("_offset") - F.col("_top")).alias("p")))
    w = w.select("to", "from", "weight")
    total = F.sum("_x").over(W.partitionBy("to", "subject"))
    moved = F.max(F.abs(F.col("weight") - F.col("_old"))).over(W.partitionBy("to"))
    done = []
    for step in range(1, steps + 1):
        mixed = p.join(w, ["to", "from"]).withColumn("_x", F.col("p") * F.col("weight"))
        new = mixed.withColumn("_t", total).groupBy("to", "from").agg(
            F.avg(F.col("_x") / F.col("_t")).alias("weight"), F.max("weight").alias("_old"))
        new = cut(new.withColumn("_still", moved < F.lit(tol)).drop("_old"))
        ended = new.agg(F.sum(F.col("_still").cast("int")).alias("ended"), F.count("*").alias("all")).first()
        w = new.select("to", "from", "weight")
        if ended["ended"]:
            done.append(new.filter("_still").select("to", "from", "weight"))
            w = new.filter(~F.col("_still")).select("to", "from", "weight")
        if ended["ended"] == ended["all"]:
            break
    for part in done:
        w = w.unionByName(part)
    return w.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy("to")))


def cumulative_fdr(df: DataFrame, lfsr: str = "lfsr", key: list[str] | None = None, out: str = "q_lfsr") -> DataFrame:
    """Mean of all local false sign rates up to and including the row, in increasing order.

    Totals of smaller values come from a bin table and, inside a bin, a window over
    distinct values.  Equal values are ordered by key in hashed slices.
    """
    from simplexflow.operators.multitest import p_bin

    key = key or ["from", "to"]
    rows = df.filter(finite(lfsr)).withColumn("_v", F.col(lfsr)).withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(64)))
    values = rows.groupBy("_v").agg(F.count("*").alias("_n")).withColumn("_bin", p_bin(F.col("_v")))
    bins = values.groupBy("_bin").agg(F.sum("_n").alias("_bn"), F.sum(F.col("_n") * F.col("_v")).alias("_bs"))
    earlier = W.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    bins = bins.select("_bin", F.coalesce(F.sum("_bn").over(earlier), zero).alias("_n0"),
                       F.coalesce(F.sum("_bs").over(earlier), F.lit(0.0)).alias("_s0"))
    inside = W.partitionBy("_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    values = values.join(bins, "_bin").select(
        "_v", (F.col("_n0") + F.coalesce(F.sum("_n").over(inside), zero)).alias("_n_before"),
        (F.col("_s0") + F.coalesce(F.sum(F.col("_n") * F.col("_v")).over(inside), F.lit(0.0))).alias("_s_before"),
    )
    parts = rows.groupBy("_v", "_part").agg(F.count("*").alias("_pn"))
    part_order = W.partitionBy("_v").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_v", "_part", F.coalesce(F.sum("_pn").over(part_order), zero).alias("_p_before"))
    local = F.row_number().over(W.partitionBy("_v", "_part").orderBy(*key))
    tie = F.col("_p_before") + F.col("_local")
    placed = rows.withColumn("_local", local).join(parts, ["_v", "_part"]).join(values, "_v")
    value = (F.col("_s_before") + tie * F.col("_v")) / (F.col("_n_before") + tie)
    return placed.select(*df.columns, value.alias(out)).unionByName(
        df.filter(~finite(lfsr)).withColumn(out, F.lit(None).cast("double"))
    )
