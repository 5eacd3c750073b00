"""Where a plan is cut so that a result used several times is computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexflow.functions.scalars import finite
from simplexflow.operators.timeaxis import time_groups


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and go on from there.

    The folder is ``spark.checkpoint.dir``.  Only a local session without one gets a
    temporary folder; a cluster without one keeps the lineage and caches instead.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            return df.persist()
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def panel_axis(panel: DataFrame, samples: DataFrame, tol: float | None = None) -> DataFrame:
    """Samples with subject, time, position and library size, computed once per run."""
    libs = panel.groupBy("sample").agg(F.sum("count").alias("_total"))
    axis = time_groups(samples, tol).join(libs, "sample", "left")
    lib = F.when(finite("_total") & (F.col("_total") > 0), F.col("_total")).otherwise(F.lit(1.0))
    return cut(axis.withColumn("lib", lib).drop("_total"))
