"""Exact quantiles per group by rank, safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from simplexflow.functions.scalars import finite
from simplexflow.operators.timeaxis import SLICE_ROWS, ordered_slices, rows_before_slice


def exact_quantiles(df: DataFrame, by: list[str], column: str, probs: dict[str, float], slice_rows=SLICE_ROWS) -> DataFrame:
    """One row per group with linearly interpolated quantiles, one column per name.

    Rows are ranked slice by slice, and only the two rows around each quantile are kept.
    """
    rows = df.filter(finite(column)).select(*by, column)
    sliced = ordered_slices(rows, by, column, slice_rows, "_n")
    rank = F.row_number().over(W.partitionBy(*by, "_slice").orderBy(column)) - 1
    ranked = sliced.withColumn("_local", rank).join(rows_before_slice(sliced, by), [*by, "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_local"))
    spots = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    near = F.lit(False)
    for spot in spots.values():
        near = near | (F.col("_rank") == F.floor(spot)) | (F.col("_rank") == F.ceil(spot))
    aggs = []
    for name, spot in spots.items():
        aggs.append(F.max(F.when(F.col("_rank") == F.floor(spot), F.col(column))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when(F.col("_rank") == F.ceil(spot), F.col(column))).alias(f"_hi_{name}"))
        aggs.append(F.max(spot - F.floor(spot)).alias(f"_f_{name}"))
    out = ranked.filter(near).groupBy(*by).agg(*aggs)
    lines = [(F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in probs]
    return out.select(*by, *lines)
