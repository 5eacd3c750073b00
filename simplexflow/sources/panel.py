"""Reading panels and sample metadata, and putting the two together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from simplexflow.functions.scalars import check_choice, finite, finite_or

GRID_BLOCKS = 32


def read_panel(df: DataFrame, sample="sample", taxon="taxon", count="count") -> DataFrame:
    """Long abundance panel; NaN and infinite counts become null at this boundary."""
    value = F.col(count).cast("double")
    return df.select(
        F.col(sample).cast("string").alias("sample"),
        F.col(taxon).cast("string").alias("taxon"),
        F.when(finite(value), value).alias("count"),
    )


def melt_panel(df: DataFrame, orient: str, key: str, columns=None) -> DataFrame:
    """Wide matrix to long panel, from either orientation."""
    check_choice("orient", orient, ("samples", "taxa"))
    columns = columns or [c for c in df.columns if c != key]
    name = "taxon" if orient == "samples" else "sample"
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(key, columns, name, "count")
    other = "sample" if orient == "samples" else "taxon"
    return long.withColumnRenamed(key, other).select("sample", "taxon", "count")


def read_samples(df: DataFrame, subject_col="subject", time_col="time", sample_col="sample") -> DataFrame:
    """Sample metadata under fixed names; an unreadable time becomes null."""
    kind, c = dict(df.dtypes)[time_col], F.col(time_col)
    if kind in ("date", "timestamp_ntz"):
        # No zone is involved, so the day and the clock time are read as they stand.
        clock = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double") if kind != "date" else F.lit(0)
        time = F.unix_date(c.cast("date")) + clock / F.lit(86400.0)
    elif kind == "timestamp":
        time = F.unix_micros(c) / F.lit(86400e6)
    else:
        time = c.try_cast("double")
    return df.select(
        F.col(sample_col).cast("string").alias("sample"),
        F.col(subject_col).cast("string").alias("subject"),
        F.when(finite(time), time).alias("time"),
    )


def grid_join(left: DataFrame, right: DataFrame, right_key: str, blocks: int = GRID_BLOCKS) -> DataFrame:
    """Every left row with every right row, as an equi-join on a cell of a grid of tasks.

    The grid is the result itself (samples by taxa).  Left rows are hashed to a row of cells and visit
    each of its blocks; right rows are hashed to a block and visit each row.  The rows follow
    the number of shuffle partitions, so there are about as many cells as tasks.  Size estimates do not see
    that visits multiply the rows, so the join is always a merge: a broadcast would take them through the driver.
    """
    rows = max(1, -(-int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    seats = right.withColumn("_block", F.pmod(F.xxhash64(right_key), F.lit(blocks)).cast("int")).withColumn("_cells", every(rows))
    visits = left.withColumn("_cells", F.pmod(F.xxhash64(*left.columns), F.lit(rows)).cast("int")).withColumn("_block", every(blocks))
    return visits.join(seats.hint("merge"), ["_cells", "_block"]).drop("_cells", "_block")


def densify(panel: DataFrame, samples: DataFrame, taxa: DataFrame) -> DataFrame:
    """Samples x taxa with absent cells set to zero."""
    grid = grid_join(samples.select("sample"), taxa.select("taxon").distinct(), "taxon")
    return grid.join(panel, ["sample", "taxon"], "left").select(
        "sample", "taxon", F.coalesce("count", F.lit(0.0)).alias("count")
    )


def require_taxa(panel: DataFrame, taxa: DataFrame | None, least: int) -> DataFrame:
    """Keep requested taxa that exist; too few is an error."""
    kept = panel if taxa is None else panel.join(taxa.select("taxon").distinct(), "taxon", "left_semi")
    found = kept.select("taxon").distinct().limit(least).count()
    if found < least:
        raise ValueError(f"need at least {least} requested taxa in the panel, found {found}")
    return kept


def with_library(panel: DataFrame) -> DataFrame:
    """Library size and relative abundance of every cell."""
    total = F.sum("count").over(W.partitionBy("sample"))
    lib = F.when(finite(total) & (total > 0), total).otherwise(F.lit(1.0))
    return panel.withColumn("lib", lib).withColumn("ra", finite_or(F.col("count") / F.col("lib"), 0.0))


def cells_on_axis(panel: DataFrame, axis: DataFrame) -> DataFrame:
    """Cells with the subject and library size already known for each sample."""
    joined = panel.join(axis.select("sample", "subject", "lib"), "sample")
    return joined.withColumn("ra", finite_or(F.col("count") / F.col("lib"), 0.0))


def join_samples(panel: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts with their metadata; samples on one side only are left out."""
    return panel.join(samples, "sample")


def filter_taxa(cells: DataFrame, n_samples: DataFrame, mean_ra_cut=None, prevalence_cut=None) -> DataFrame:
    """Taxon filters on sparse cells, placed before any pairing.

    ``n_samples`` is a one-row frame with column ``n``: absent cells count as zeros.
    """
    if mean_ra_cut is None and prevalence_cut is None:
        return cells
    n = n_samples.scalar()
    stats = cells.groupBy("taxon").agg(
        F.sum("ra").alias("s"), F.sum(F.when(F.col("ra") > 0, 1.0).otherwise(0.0)).alias("nz")
    )
    keep = F.lit(True)
    if mean_ra_cut is not None:
        keep = keep & (F.col("s") / n >= F.lit(float(mean_ra_cut)))
    if prevalence_cut is not None:
        keep = keep & (F.col("nz") / n >= F.lit(float(prevalence_cut)))
    return cells.join(stats.filter(keep).select("taxon"), "taxon", "left_semi")


def align_panels(a: DataFrame, b: DataFrame, prefer: str = "a", least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two panels cut to their shared samples.  ``prefer`` names the panel listed first."""
    check_choice("prefer", prefer, ("a", "b"))
    common = a.select("sample").distinct().join(b.select("sample").distinct(), "sample", "left_semi")
    found = common.limit(least).count()
    if found < least:
        raise ValueError(f"need at least {least} shared samples, found {found}")
    a2, b2 = a.join(common, "sample", "left_semi"), b.join(common, "sample", "left_semi")
    return (a2, b2) if prefer == "a" else (b2, a2)


def merge_metadata(first: DataFrame, second: DataFrame) -> DataFrame:
    """Metadata of shared samples: the first panel wins, conflicts are flagged."""
    other = second.select("sample", F.col("subject").alias("_s2"), F.col("time").alias("_t2"))
    clash = ~(F.col("subject").eqNullSafe(F.col("_s2")) & F.col("time").eqNullSafe(F.col("_t2")))
    return first.join(other, "sample").select("sample", "subject", "time", clash.alias("conflict"))


def write_bundle(tables: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None) -> None:
    """One parquet folder per result table."""
    partition_by = partition_by or {}
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{path.rstrip('/')}/{name}")
