"""Pairing parts sample by sample.

One row per (pair, sample) is the largest table of any job, so it is never moved.  The
panel is cut into tiles: a subject chunk times a block of parts i times a block of parts
j.  Only panel rows are shuffled to tiles.  The pair join, the windows over one series
and the first half of each aggregate then run inside the tile, because a partitioning by
the tile keys also serves every grouping that contains them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from simplexflow.operators.timeaxis import AxisProfile
from simplexflow.sources.panel import grid_join

TILE = ["subject", "chunk", "bi", "bj"]
PAIR = ["i", "j"]
SERIES = ["i", "j", "subject"]
BLOCKS = 4
#: Pair rows of a tile, and tiles of a task, that let a subject's parts stay in one block.
TILE_ROWS = 1 << 20
TASK_TILES = 16


def keep_tiles_together(spark) -> None:
    """Let a join on tile keys plus sample use a partitioning by the tile keys alone.

    With the default setting Spark spreads each tile over all tasks for the join and then
    has to move every pair row once more for the windows.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for work that costs far more than its input bytes suggest.

    A fixed number keeps adaptive execution from merging small-looking partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def blocks_for(panel: DataFrame, profile: AxisProfile, most: int = BLOCKS) -> int:
    """Blocks of parts: one if tiles of all parts are small and the subjects alone give every task enough of them, else ``most``.

    Every block more sends a dense row to one more tile on each side.
    """
    if most == 1 or profile.subjects < TASK_TILES * int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return most
    parts = panel.agg(F.approx_count_distinct("taxon")).first()[0]
    return 1 if min(profile.longest, profile.chunk_rows) * parts * parts <= TILE_ROWS else most


def support(cells: DataFrame) -> DataFrame:
    """(subject, taxon) sums over present cells; absent cells are zeros added by the caller."""
    nonzero = F.when(F.col("ra") > 0, 1).otherwise(0)
    return cells.groupBy("subject", "taxon").agg(
        F.count("*").alias("n_cells"),
        F.sum(nonzero).alias("n_nonzero"),
        F.avg("ra").alias("cell_mean"),
        (F.var_pop("ra") * F.count("*")).alias("cell_ss"),
        F.min(F.when(F.col("ra") > 0, F.col("ra"))).alias("min_pos"),
    )


def zero_filled_moments(n: Column) -> dict[str, Column]:
    """Mean, variance and non-zero share once the ``n - n_cells`` zeros are counted."""
    zeros = n - F.col("n_cells")
    ss = F.col("cell_ss") + F.col("cell_mean") * F.col("cell_mean") * F.col("n_cells") * zeros / n
    return {
        "mean_ra": F.col("cell_mean") * F.col("n_cells") / n,
        "var_ra": F.when(n > 1, ss / (n - 1)),
        "nz_share": F.col("n_nonzero") / n,
    }


def dense_series(cells: DataFrame, axis: DataFrame, members: DataFrame) -> DataFrame:
    """Dense rows for the given (subject, taxon) members on the chunked axis of each subject.

    ``members`` may carry more columns; they ride along.  Joined by (subject, chunk), so
    a subject with many samples is spread over its chunks.
    """
    chunks = axis.select("subject", "chunk").distinct()
    spread = members.join(chunks, "subject").repartition("subject", "chunk")
    rows = axis.repartition("subject", "chunk").join(spread, ["subject", "chunk"])
    present = cells.select("sample", "taxon", "count")
    return rows.join(present, ["sample", "taxon"], "left").withColumn("count", F.coalesce("count", F.lit(0.0)))


def pair_rows(
    left: DataFrame,
    right: DataFrame | None = None,
    *,
    carry: list[str] | None = None,
    touching: DataFrame | None = None,
    blocks: int = BLOCKS,
) -> DataFrame:
    """All pairs of parts in each sample; ``ci`` and ``cj`` are the counts.

    With one frame: unordered pairs, ``i < j``.  With two: every left part with every
    right part.  ``carry`` lists per-part columns to bring from both sides.
    ``touching`` keeps pairs with at least one listed part.  About 64 parts per block
    keep one tile near a million rows; raise ``blocks`` with the number of parts.
    """
    keep_tiles_together(left.sparkSession)
    carry = ["count"] + (carry or [])
    shared = [c for c in left.columns if c not in carry + ["taxon", "_pick"]]
    if touching is not None:
        marks = touching.select("taxon", F.lit(True).alias("_pick")).distinct()
        left = left.join(marks, "taxon", "left")
        right = right.join(marks, "taxon", "left") if right is not None else None
    pick = ["_pick"] if touching is not None else []
    block = F.pmod(F.xxhash64("taxon"), F.lit(blocks)).cast("int")
    one = right is None
    last, first = F.lit(blocks - 1), F.lit(0)

    li = left.withColumn("bi", block).withColumn("bj", F.explode(F.sequence("bi" if one else first, last)))
    rj = (left if one else right).withColumn("bj", block)
    rj = rj.withColumn("bi", F.explode(F.sequence(first, "bj" if one else last)))
    named = {"taxon": "t", "count": "c", "_pick": "_pick"}
    names = {c: named.get(c, c) for c in ["taxon"] + carry + pick}
    li = li.select(*shared, "bi", "bj", *[F.col(c).alias(f"{n}_l") for c, n in names.items()])
    rj = rj.select("sample", *TILE, *[F.col(c).alias(f"{n}_r") for c, n in names.items()])
    li, rj = spread(li, *TILE), spread(rj, *TILE)

    rows = li.join(rj, [*TILE, "sample"])
    if one:
        rows = rows.filter((F.col("bi") < F.col("bj")) | (F.col("t_l") < F.col("t_r")))
    if touching is not None:
        rows = rows.filter(F.coalesce("_pick_l", F.lit(False)) | F.coalesce("_pick_r", F.lit(False)))
    ahead = (F.col("t_l") < F.col("t_r")) if one else F.lit(True)
    out = [c for c in rows.columns if not c.endswith(("_l", "_r"))]
    columns = [F.col(c) for c in out]
    for n in [v for k, v in names.items() if k != "_pick"]:
        i_name, j_name = {"t": ("i", "j"), "c": ("ci", "cj")}.get(n, (f"{n}_i", f"{n}_j"))
        columns.append(F.when(ahead, F.col(f"{n}_l")).otherwise(F.col(f"{n}_r")).alias(i_name))
        columns.append(F.when(ahead, F.col(f"{n}_r")).otherwise(F.col(f"{n}_l")).alias(j_name))
    return rows.select(*columns)


def all_pairs(taxa: DataFrame, touching: DataFrame | None = None) -> DataFrame:
    """Every unordered pair of the listed parts, without any data attached."""
    left = taxa.select(F.col("taxon").alias("i"))
    out = grid_join(left, taxa.select(F.col("taxon").alias("j")), "j").filter(F.col("i") < F.col("j"))
    if touching is None:
        return out
    marks = touching.select(F.col("taxon").alias("_t"), F.lit(True).alias("_m")).distinct()
    for side in ("i", "j"):
        out = out.join(marks.withColumnsRenamed({"_t": side, "_m": f"_m{side}"}), side, "left")
    return out.filter(F.coalesce("_mi", "_mj")).select("i", "j")


def series_window(*order: str):
    """One pair's series inside its tile; ordered by ``order`` if given."""
    w = W.partitionBy(*TILE, "i", "j")
    return w.orderBy(*order) if order else w


def series_stats(rows: DataFrame, stats: dict[str, Column], profile: AxisProfile) -> DataFrame:
    """Attach aggregates of each (pair, subject) series to its rows.

    When every subject fits in one chunk this is a window inside the tile and moves
    nothing; it is in the order of lags, so that one sort serves both.  Otherwise the chunks are first combined by an aggregate and joined back.
    """
    if profile.one_chunk:
        whole = series_window("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return rows.withColumns({k: v.over(whole) for k, v in stats.items()})
    counted = rows.filter(~F.col("halo"))
    return rows.join(counted.groupBy(*SERIES).agg(*[v.alias(k) for k, v in stats.items()]), SERIES)


def both_directions(pairs: DataFrame) -> DataFrame:
    """Each unordered pair as two directed edges, ``from`` acting on ``to``."""
    keep = [c for c in pairs.columns if c not in ("i", "j")]
    one = pairs.select(F.col("i").alias("from"), F.col("j").alias("to"), *keep)
    two = pairs.select(F.col("j").alias("from"), F.col("i").alias("to"), *keep)
    return one.unionByName(two)
