"""The time axis of each subject: order, gap groups, chunks.

Everything here depends on the sample table alone, never on a pair, so it is computed
once per sample and not once per pair-sample.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from simplexflow.functions.scalars import check_choice, finite

SLICE_ROWS = 65536
CHUNK_ROWS = 16384
#: Rows of a task that sorts; a partitioning by number is not merged again by bytes, as adaptive execution would.
TASK_ROWS = 1 << 17


def tasks_for(rows: int) -> int:
    """Tasks so that each sorts about ``TASK_ROWS`` rows, whatever the size of the table."""
    return max(1, -(-int(rows) // TASK_ROWS))


def ordered_slices(df: DataFrame, by: list[str], order: str, slice_rows: int = SLICE_ROWS, size: str | None = None):
    """Add ``_slice``: a coarse bin of ``order`` inside each group, one bin per ``slice_rows`` rows.

    The bin is a non-decreasing function of ``order``, so a rank is the rows in earlier
    bins plus the rank inside the bin.  A group that holds a third of the table is then
    ordered by many tasks.  Groups below ``slice_rows`` have one bin.  ``size`` names a
    column for the rows of the group.
    """
    bounds = df.groupBy(*by).agg(
        F.min(order).alias("_lo"),
        F.max(order).alias("_hi"),
        F.ceil(F.count("*") / F.lit(slice_rows)).alias("_bins"),
        *([] if size is None else [F.count("*").alias(size)]),
    )
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    place = F.floor((F.col(order) - F.col("_lo")) / width * F.col("_bins"))
    sliced = df.join(bounds, by).withColumn("_slice", F.least(place, F.col("_bins") - 1).cast("long"))
    return sliced.drop("_lo", "_hi", "_bins")


def rows_before_slice(sliced: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Rows (or summed weight) in earlier slices: one row per slice, so windows stay small."""
    per = sliced.groupBy(*by, "_slice").agg(F.sum(F.lit(1) if weight is None else weight).alias("_rows"))
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")


def time_groups(samples: DataFrame, tol: float | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Order the samples of each subject and give equal or near times one position.

    Adds ``pos`` (0-based index of the time group), ``group_time`` (mean time of the
    group), ``group_n`` (samples in it) and ``n_groups``.  With ``tol`` a new group
    starts where the gap to the previous sample exceeds ``tol``; without it where the
    time differs.
    """
    from simplexflow.plans.lineage import cut

    clean = samples.filter(finite("time") & F.col("subject").isNotNull())
    stamps = cut(clean.groupBy("subject", "time").agg(F.count("*").alias("_copies")))
    tasks = tasks_for(stamps.count())
    inside = W.partitionBy("subject", "_slice").orderBy("time")
    limit = F.lit(0.0 if tol is None else float(tol))  # distinct times differ by more than 0
    sliced = ordered_slices(stamps, ["subject"], "time", slice_rows).repartition(tasks, "subject", "_slice")
    walked = sliced.withColumn("_start", (F.coalesce(F.col("time") - F.lag("time").over(inside), limit) > limit).cast("int"))
    walked = cut(walked.withColumn("_local", F.sum("_start").over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("_start"))
    # One row per slice: whether its first row starts a group too, and the groups of the slices before.
    along = W.partitionBy("subject").orderBy("_slice")
    slices = walked.groupBy("subject", "_slice").agg(F.min("time").alias("_first"), F.max("time").alias("_last"), F.max("_local").alias("_starts"))
    gap = F.col("_first") - F.lag("_last").over(along)
    slices = slices.withColumn("_open", F.when(gap <= limit, 0).otherwise(1)).withColumn("_new", F.col("_open") + F.col("_starts"))
    slices = slices.select("subject", "_slice", F.sum("_new").over(W.partitionBy("subject")).alias("n_groups"),
                           (F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("_starts") - 1).alias("_before"))
    placed = walked.join(slices.repartition(tasks, "subject", "_slice"), ["subject", "_slice"])
    placed = placed.select("subject", "time", "_copies", (F.col("_before") + F.col("_local")).cast("long").alias("pos"), "n_groups")
    if tol is None:
        stamps = placed.withColumns({"group_time": F.col("time"), "group_n": F.col("_copies")})
    else:
        placed = cut(placed)
        groups = placed.groupBy("subject", "pos").agg(
            (F.sum(F.col("time") * F.col("_copies")) / F.sum("_copies")).alias("group_time"),
            F.sum("_copies").alias("group_n"),
        )
        stamps = placed.join(groups.repartition(tasks, "subject", "pos"), ["subject", "pos"])
    stamps = stamps.select("subject", "time", "pos", "group_time", "group_n", "n_groups")
    return clean.join(stamps.repartition(tasks, "subject", "time"), ["subject", "time"])


@dataclass(frozen=True)
class AxisProfile:
    """Numbers about the sample table that choose a plan shape; ``subjects`` is an estimate."""

    longest: int
    has_repeats: bool
    chunk_rows: int
    subjects: int = 0

    @property
    def one_chunk(self) -> bool:
        return self.longest <= self.chunk_rows


def profile_axis(axis: DataFrame, chunk_rows: int = CHUNK_ROWS) -> AxisProfile:
    """One small aggregate over the sample table (not over the panel)."""
    row = axis.agg(F.max("n_groups").alias("n"), F.max("group_n").alias("copies"), F.approx_count_distinct("subject").alias("subjects")).first()
    return AxisProfile(int(row["n"] or 0), bool((row["copies"] or 0) > 1), chunk_rows, int(row["subjects"]))


def assign_chunks(axis: DataFrame, chunk_rows: int = CHUNK_ROWS, halo: int = 0) -> DataFrame:
    """Cut long subjects into chunks of ``chunk_rows`` positions.

    A chunk also receives the last ``halo`` positions of the chunk before it, marked
    ``halo = true``.  They feed lags and filter burn-in and are never counted.
    """
    size = F.lit(chunk_rows)
    own = F.struct(F.floor(F.col("pos") / size).alias("chunk"), F.lit(False).alias("halo"))
    spill = F.struct((F.floor(F.col("pos") / size) + 1).alias("chunk"), F.lit(True).alias("halo"))
    tail = (F.col("pos") % size >= size - halo) & ((F.floor(F.col("pos") / size) + 1) * size < F.col("n_groups"))
    seats = F.when(tail, F.array(own, spill)).otherwise(F.array(own))
    return axis.withColumn("_seat", F.explode(seats)).select("*", "_seat.*").drop("_seat")


def merge_times(df: DataFrame, time: str, by: list[str], cols: list[str], how: str = "median", tol=None) -> DataFrame:
    """Merge rows of equal (or nearer than ``tol``) time by mean or median."""
    check_choice("how", how, ("median", "mean"))
    pick = F.median if how == "median" else F.avg
    if tol is None:
        return df.groupBy(*by, F.col(time)).agg(*[pick(c).alias(c) for c in cols])
    w = W.partitionBy(*by).orderBy(time)
    gap = F.col(time) - F.lag(time).over(w)
    start = F.when(gap.isNull() | (gap > F.lit(float(tol))), 1).otherwise(0)
    grouped = df.withColumn("_start", start).withColumn("_group", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "_group").agg(F.avg(time).alias(time), *[pick(c).alias(c) for c in cols]).drop("_group")


def next_interval(samples: DataFrame, min_dt: float = 1e-8) -> DataFrame:
    """Interval to the next row of the subject, kept when both ends are finite and dt > ``min_dt``."""
    w = W.partitionBy("subject").orderBy("time")
    out = samples.withColumn("next_time", F.lead("time").over(w)).withColumn("dt", F.col("next_time") - F.col("time"))
    return out.filter(finite("time") & finite("next_time") & (F.col("dt") > F.lit(min_dt)))


def previous_link(df: DataFrame, by: list[str], time: str = "time", bad_dt: float = 1e-6) -> DataFrame:
    """Row index, previous row index (0 for the first) and dt to it (0 for the first)."""
    w = W.partitionBy(*by).orderBy(time)
    row = F.row_number().over(w)
    gap = F.col(time) - F.lag(time).over(w)
    dt = F.when(F.col("row") == 1, F.lit(0.0)).when(finite("_gap") & (F.col("_gap") > 0), F.col("_gap")).otherwise(F.lit(bad_dt))
    return df.withColumn("row", row).withColumn("_gap", gap).withColumn("dt", dt).withColumn("prev", F.col("row") - 1).drop("_gap")


def time_unit(links: DataFrame, by: list[str]) -> DataFrame:
    """Mean positive dt."""
    unit = F.avg(F.when(F.col("dt") > 0, F.col("dt")))
    return links.groupBy(*by).agg(F.coalesce(unit, F.lit(1.0)).alias("unit"))


def interpolate(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Fill null values on a line between known neighbours, flat beyond the ends."""
    w = W.partitionBy(*by).orderBy(time)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    out = df.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(ahead))
    share = (F.col(time) - F.col("_a.t")) / F.when(F.col("_b.t") > F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    line = F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v"))
    return out.withColumn(value, F.coalesce(F.col(value), line, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")
