"""Repeated K-fold over subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from simplexflow.plans.lineage import cut
from simplexflow.sources.panel import grid_join

SLICES = 256


def kfold_splits(subjects: DataFrame, k: int = 5, r: int = 3, seed: int = 1234) -> DataFrame:
    """``rep, fold, subject``: each subject is held out once per repeat, folds differ by at most one.

    Subjects are ordered by a seeded hash.  The order is counted in 256 hash slices, so
    no task sees all subjects.
    """
    unique = subjects.select("subject").distinct()
    found = unique.limit(k).count()
    if found < k:
        raise ValueError(f"{k} folds need at least {k} subjects, found {found}")
    reps = unique.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(int(r)))))
    ordered = reps.withColumn("_h", F.xxhash64(F.lit(int(seed)), "rep", "subject"))
    ordered = ordered.withColumn("_slice", F.pmod("_h", F.lit(SLICES)))
    per = ordered.groupBy("rep", "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy("rep").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_before") + F.row_number().over(W.partitionBy("rep", "_slice").orderBy("_h", "subject")) - 1
    out = ordered.join(per, ["rep", "_slice"]).withColumn("_place", place)
    return out.select("rep", (F.pmod("_place", F.lit(int(k))) + 1).cast("int").alias("fold"), "subject")


def fold_lists(splits: DataFrame) -> DataFrame:
    """One row per subject: its fold in each repeat, in repeat order."""
    pairs = F.array_sort(F.collect_list(F.struct("rep", "fold")))
    return splits.groupBy("subject").agg(F.transform(pairs, lambda s: s["fold"]).alias("folds"))


def train_test(inputs: DataFrame, splits: DataFrame, rep: int, fold: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the subjects outside and inside one fold."""
    held = splits.filter((F.col("rep") == rep) & (F.col("fold") == fold)).select("subject")
    return inputs.join(held, "subject", "left_anti"), inputs.join(held, "subject", "left_semi")


def fold_status(inputs: DataFrame, splits: DataFrame, min_pairs: int = 4) -> DataFrame:
    """Train and test rows of every (edge, repeat, fold) and whether the fold is usable.

    Counts are first taken per (edge, subject), then combined per fold; the training
    count is the total minus the held-out count.
    """
    per = cut(inputs.groupBy("from", "to", "subject").agg(F.count("*").alias("n")))
    total = per.groupBy("from", "to").agg(F.sum("n").alias("n_all"))
    held = per.join(splits, "subject").groupBy("from", "to", "rep", "fold").agg(F.sum("n").alias("n_test"))
    folds = splits.select("rep", "fold").distinct()
    out = grid_join(total, folds, "fold").join(held, ["from", "to", "rep", "fold"], "left").withColumn("n_test", F.coalesce("n_test", F.lit(0)))
    out = out.withColumn("n_train", F.col("n_all") - F.col("n_test"))
    status = (
        F.when(F.col("n_test") == 0, "empty_test")
        .when(F.col("n_train") == 0, "empty_train")
        .when(F.col("n_train") < min_pairs, "short_train")
        .otherwise("ok")
    )
    return out.withColumn("fold_status", status).drop("n_all")


def held_out_counts(splits: DataFrame) -> DataFrame:
    """How often each subject was held out."""
    return splits.groupBy("subject").agg(F.count("*").alias("n_test"))
