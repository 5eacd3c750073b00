"""Merkle manifest of a table by checkpoint-and-recompute.

Each row is a leaf; the leaves of a group (``lang``), in order of their ids, form a tree of pairs whose top is the
group's subroot, and the subroots form a tree of pairs whose top is the root.  A node is the SHA-256 (hex) of the
concatenated digests below it; a last node without a neighbour is hashed alone.

Only every ``step``-th level is stored: one row per aligned subtree holds its 2**step descendants of that level.  The
levels between are made again from them when a proof asks for one: from the top down, each stored subtree gets
the path above it, makes its interior nodes again, hands each of its nodes the siblings on the way
up, and drops them.  So the stored tree takes 1 / (2**step - 1) of its leaves, and no node meets more than 2**step others.

Leaves get their places without a global sort in one task: rows are range-partitioned by (group, id, digest), and a
table with one row per partition and group says where each partition starts.  A group with a third of all
rows is so spread over many partitions.  All work is column expressions; texts are read once and never shuffled.

Defined cases: a null field is ``-``; null ids and null groups sort first; repeated ids are ordered by their
digests, and rows that are equal in all fields have equal digests, so each place among them has its own proof; a group with one
row has that leaf as subroot; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplexflow.llm.tables import parts_for
from simplexflow.plans.lineage import cut

#: Levels between two stored ones.
STEP = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 over each field as byte count, ``:`` and value, or ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def height(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in ``order``) inside their group ``g`` and the group's ``size``."""
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    spread = max(parts_for(rows.count(), 1 << 17), 1)
    wide = spread > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(spread, *keys) if wide else rows.repartitionByRange(*keys)
    dealt = cut(dealt.sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    starts = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("g")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(starts.select("g", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size")))
    return dealt.join(starts, ["g", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _above(nodes: Column) -> Column:
    """The level over ``nodes``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")),
                       lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256))


def _rounds(level: int, step: int) -> Column:
    """Levels that a subtree stored at ``level`` still has to its own top."""
    return F.least(F.lit(step), F.greatest(F.lit(0), height(F.col("size")) - level))


def _levels(nodes: Column, level: int, step: int) -> Column:
    """All levels of a stored subtree, made again from its stored nodes: an array of arrays."""
    rounds = F.filter(F.sequence(F.lit(1), F.lit(step)), lambda r: r <= _rounds(level, step))
    return F.aggregate(rounds, F.array(nodes), lambda made, _: F.concat(made, F.array(_above(F.element_at(made, -1)))))


class Tree:
    """Trees of all groups of ``leaves``: ``g, size, pos, node`` (digest) and ``carried`` (a struct that stays with the leaf).

    ``stored[k]`` has one row per aligned subtree, ``g, size, idx, nodes`` with its nodes of level ``k * step``.
    """

    def __init__(self, leaves: DataFrame, step: int = STEP):
        self.step, self.stored = step, []
        nodes, level, top = leaves, 0, 1
        while level < top:
            held = F.struct("pos", "node", *(["carried"] if level == 0 else []))
            rows = nodes.groupBy("g", "size", F.shiftright("pos", step).alias("idx")).agg(F.array_sort(F.collect_list(held)).alias("nodes"))
            self.stored.append(cut(rows))
            made = _levels(F.col("nodes.node"), level, step)
            nodes = self.stored[-1].select("g", "size", F.col("idx").alias("pos"), F.element_at(F.element_at(made, -1), 1).alias("node"))
            if level == 0:
                top = self.stored[0].agg(F.max(height(F.col("size")))).first()[0] or 0
            level += step
        self.tops = cut(nodes.select("g", "node"))

    def proofs(self, paths: DataFrame) -> DataFrame:
        """``g, carried, node, path`` and the further columns of ``paths`` for every leaf.

        ``paths``: ``g, path`` of each tree's top; a path is an array of ``digest`` (null: no sibling) and ``right`` (the
        node is the right one).
        """
        more = [c for c in paths.columns if c not in ("g", "path")]
        paths = paths.withColumn("idx", F.lit(0).cast("bigint"))
        for k in range(len(self.stored) - 1, -1, -1):
            rows = self.stored[k].withColumn("levels", _levels(F.col("nodes.node"), k * self.step, self.step)).join(paths, ["g", "idx"])
            rows = rows.select("g", "size", "idx", "levels", "path", *more, F.posexplode("nodes").alias("j", "own"))
            up = F.transform(F.slice("levels", 1, F.size("levels") - 1), lambda level, r: F.struct(
                F.get(level, F.call_function("shiftright", F.col("j"), r).bitwiseXOR(1)).alias("digest"),
                (F.call_function("shiftright", F.col("j"), r).bitwiseAND(1) == 1).alias("right")))
            rows = rows.withColumn("path", F.concat(up, "path"))
            if k:
                paths = rows.select("g", F.col("own.pos").alias("idx"), "path", *more)
        return rows.select("g", "own.carried", "own.node", "path", *more)


NO_PATH = "array<struct<digest:string,right:boolean>>"


def folded(leaf: Column, path: Column) -> Column:
    """The top that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.when(p["digest"].isNull(), h).when(p["right"], F.concat(p["digest"], h)).otherwise(
        F.concat(h, p["digest"])), 256))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, doc_id: str = "doc_id", group: str = "lang", changed: dict[str, Column] | None = None,
             step: int = STEP) -> DataFrame:
    """``id, leaf, changed_leaf, subroot, root, path`` of every row; ``path`` leads from the leaf by its subroot to the root.

    ``changed`` gives other values of some fields; ``changed_leaf`` is the digest with them.
    """
    changed = changed or {}
    own = [F.col(f) for f in fields]
    other = [changed.get(f, F.col(f)) for f in fields]
    rows = cut(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("g"),
                           leaf_digest(own).alias("node"), leaf_digest(other).alias("changed")))
    leaves = numbered(rows, ["id", "node"]).select("g", "size", "pos", "node", F.struct("id", "changed").alias("carried"))
    trees = Tree(leaves, step)
    tops = numbered(trees.tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), ["name"])
    whole = Tree(tops.select("g", "size", "pos", "node", F.struct("name").alias("carried")), step)
    root = whole.tops.select("g", F.col("node").alias("root"), F.array().cast(NO_PATH).alias("path"))
    above = whole.proofs(root).select(F.col("carried.name").alias("g"), F.col("node").alias("subroot"), "root", "path")
    out = trees.proofs(cut(above))
    return out.select(F.col("carried.id").alias("id"), F.col("node").alias("leaf"), F.col("carried.changed").alias("changed_leaf"), "subroot", "root", "path")
