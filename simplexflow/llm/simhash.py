"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has one or four 64-bit words; each bit is the majority over the hashes of all
word shingles.  Equal fingerprints are one class.  Distinct fingerprints are compared with
numpy exclusive-or and bit counts inside *tiles*: blocks of at most about ``TILE`` rows.

Which rows can meet in a tile:

- small radius (``linked``): the word is cut in 2 * radius blocks; two fingerprints within the
  radius agree on half of them (pigeonhole), so every choice of that half is a bucket key;
- similarity of sets (``keep_one``): two sets of Jaccard similarity s share one of the first n - ceil(s n) + 1 members of
  either in any common order, so these prefixes, rare members first, are the bucket keys.

A bucket larger than a tile is cut by population count in bins as wide as the radius plus one, and the
bins by a hash; tile pairs whose bins are not the same or neighbours cannot hold a link and
are never formed.  A tile pair returns a spanning forest of its links and not all of them,
so a group of n near copies gives at most n - 1 rows per tile pair, and no link between
different classes is lost for the components.

Defined cases: a text without words (null or empty too) has fingerprint zero, linked like any other;
repeated rows and equal texts share a class; null ids never are a component's name unless all its
ids are null; an empty table gives an empty table; further columns pass through untouched.
"""

from __future__ import annotations

import itertools
import math
import string
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from simplexflow.llm.components import components
from simplexflow.llm.ngramjoin import Shingler, fitting_bits, groups
from simplexflow.llm.tables import row_key, shared_folder, small_batches, spare
from simplexflow.plans.lineage import cut

TILE = 4096
#: Rows of the table of frequent members, which only says what a prefix takes last.
COMMON = 1 << 18
#: Members of sets that a task holds before it hands on the frequent ones, or their keys.
FLUSH = 1_000_000
HASH = partial(xxhash.xxh64_intdigest, seed=42)
#: Odd multipliers that make further words from one hash (any fixed odd numbers do).
MIX = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
DROP = string.punctuation.encode()


def shingles(text: str | None, size: int, bare: bool) -> list[bytes]:
    """Word shingles, repeats included; the whole sequence if it is shorter.

    A-Z are lower-cased; with ``bare`` ASCII punctuation is dropped before words are taken.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = (raw.translate(None, DROP) if bare else raw).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def _bits(h: np.ndarray, words: int) -> np.ndarray:
    """The bits of the fingerprint words of each hash."""
    wide = h[:, None] * MIX[:words]
    if words > 1:
        wide[:, 1:] ^= wide[:, 1:] >> np.uint64(29)
        wide[:, 1:] *= np.uint64(0xBF58476D1CE4E5B9)
        wide[:, 1:] ^= wide[:, 1:] >> np.uint64(32)
    return np.unpackbits(wide.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")


def fingerprint(text: str | None, size: int, words: int = 1, bare: bool = False) -> tuple[np.ndarray, int]:
    """The fingerprint words (uint64) and the number of shingles."""
    grams = shingles(text, size, bare)
    counts = np.zeros(64 * words, dtype=np.int64)
    for start in range(0, len(grams), 16384):
        part = grams[start:start + 16384]
        h = np.fromiter(map(HASH, part), dtype=np.uint64, count=len(part))
        bits = _bits(h, words)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(grams), bitorder="little").view("<u8"), len(grams)


PRINT_TYPE = StructType([StructField("fp", ArrayType(LongType(), False), False), StructField("n_shingles", IntegerType(), False)])


def fingerprint_column(text: str, size: int, words: int = 1, bare: bool = False) -> Column:
    @F.pandas_udf(PRINT_TYPE)
    def prints(texts: pd.Series) -> pd.DataFrame:
        made = [fingerprint(t, size, words, bare) for t in texts]
        return pd.DataFrame({"fp": [m[0].view(np.int64) for m in made], "n_shingles": [m[1] for m in made]})

    return prints.asNondeterministic()(F.col(text))


def _bit_buckets(radius: int) -> Column:
    """Keys of the pigeonhole: every choice of half of ``2 * radius`` blocks of the first word."""
    blocks = 2 * radius
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), radius)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).alias("t"), F.col("fp")[0].bitwiseAND(F.lit(mask)).alias("key"), F.lit(True).alias("home")))
    return F.array(*keys)


def _forest(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links that join different labels; ``labels`` is a union-find table changed in place."""
    used = []

    def root(i: int) -> int:
        while labels[i] != i:
            labels[i] = labels[labels[i]]
            i = labels[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = root(i), root(j)
        if x != y:
            labels[max(x, y)] = min(x, y)
            used.append((i, j))
    return used


def _links(fp: np.ndarray, n: np.ndarray, home: np.ndarray, near: list[int], similarity: float | None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows of one tile pair."""
    labels = np.arange(len(fp))
    used: list[tuple[int, int]] = []
    first = np.ascontiguousarray(fp[:, 0])
    step = max(1, (1 << 20) // max(1, len(fp)))
    for start in range(0, len(fp), step):
        rows = slice(start, start + step)
        hit = np.bitwise_count(first[rows, None] ^ first[None, start:]) <= near[0]
        a, b = np.nonzero(hit)
        a, b = a + start, b + start
        ok = (a < b) & (home[a] | home[b])
        a, b = a[ok], b[ok]
        if similarity is not None:
            ok = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])
            a, b = a[ok], b[ok]
        if fp.shape[1] > 1:
            ok = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= near[1]
            a, b = a[ok], b[ok]
        roots = labels
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]
        labels[:] = roots
        ok = labels[a] != labels[b]
        used += _forest(a[ok], b[ok], labels)
    return used


def _tile_links(near: list[int], similarity: float | None, name: str | None = None):
    """Partitions sorted by tile pair in, spanning links out (of fingerprints, or of the column ``name``); one tile pair is in memory at a time."""
    kind = LINKS if name is None else pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in groups(batches, ["t", "key", "tile"]):
            if rows.num_rows < 2:
                continue
            fp = np.concatenate([c.flatten().to_numpy() for c in rows.column("fp").chunks]).reshape(rows.num_rows, -1)
            n, home = rows.column("n_shingles").to_numpy(), rows.column("home").to_numpy()
            names = fp if name is None else rows.column(name).to_numpy()
            out += [(names[i].tolist(), names[j].tolist()) for i, j in _links(fp.view(np.uint64), n, home, near, similarity)]
            if len(out) > 5000:
                yield pa.RecordBatch.from_pydict({"u": [a for a, _ in out], "v": [b for _, b in out]}, schema=kind)
                out = []
        yield pa.RecordBatch.from_pydict({"u": [a for a, _ in out], "v": [b for _, b in out]}, schema=kind)

    return run


LINKS = pa.schema([("u", pa.list_(pa.int64())), ("v", pa.list_(pa.int64()))])


def _tiles(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rows with ``t``, ``key``, ``home`` get a ``tile`` number; rows of large buckets once per tile pair."""
    pops = F.expr("aggregate(slice(fp, 1, 1), 0, (s, x) -> s + bit_count(x))")
    rows = rows.withColumn("bin", F.floor(pops / (radius + 1)).cast("int"))
    bins = rows.groupBy("t", "key", "bin").agg(F.count(F.lit(1)).alias("n"))
    sizes = bins.groupBy("t", "key").agg(F.sum("n").alias("m"), F.collect_list(F.struct("bin", "n")).alias("bins"))
    sizes = cut(sizes.where("m > 1"))  # at most 64 / (radius + 1) + 1 bins in a list
    part = lambda b: F.coalesce(F.expr(f"aggregate(filter(bins, x -> x.bin = bin + {b}), 0L, (s, x) -> s + ceil(x.n / {tile}))"), F.lit(0))
    met = rows.join(sizes, ["t", "key"])
    met = met.withColumns({"mine": part(0), "below": part(-1), "above": part(1)})
    met = met.withColumn("salt", F.pmod(F.xxhash64("fp"), F.greatest("mine", F.lit(1))))
    # A tile pair's number: bin, then which neighbour, then the two salts.
    number = lambda low, kind, a, b: (((low * 2 + kind) * F.lit(1 << 24) + a) * F.lit(1 << 24) + b)
    bin_ = F.col("bin").cast("long")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<bigint>"))
    pairs = F.concat(
        F.transform(upto("mine"), lambda j: number(bin_, F.lit(0), F.least(F.col("salt"), j), F.greatest(F.col("salt"), j))),
        F.transform(upto("above"), lambda j: number(bin_, F.lit(1), F.col("salt"), j)),
        F.transform(upto("below"), lambda j: number(bin_ - 1, F.lit(1), j, F.col("salt"))))
    one = F.array(F.lit(-1).cast("long"))
    return met.select(*rows.columns[:-1], F.explode(F.when(F.col("m") <= tile, one).otherwise(pairs)).alias("tile"))


def linked(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links ``u``, ``v`` among distinct fingerprints ``fp``, ``n_shingles``: a spanning set of all links.

    A link: the first words differ in at most ``radius`` bits.
    """
    rows = prints.select("fp", "n_shingles", F.explode(_bit_buckets(radius)).alias("b")).select("fp", "n_shingles", "b.*")
    return _in_tiles(_tiles(rows, radius, tile), [radius], None).distinct()


def _in_tiles(rows: DataFrame, near: list[int], similarity: float | None, name: str | None = None) -> DataFrame:
    kind = "bigint" if name else "array<bigint>"
    sorted_ = rows.repartition("t", "key", "tile").sortWithinPartitions("t", "key", "tile")
    return sorted_.mapInArrow(_tile_links(near, similarity, name), f"u {kind}, v {kind}")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """One row per document: ``id``, ``row_key``, ``fp``, ``root`` (least fingerprint of its component, which names it) and ``component_id``
    (least id of the component; components may share it where ids are null or repeated).
    """
    prints = cut(docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("row_key"),
                             fingerprint_column(text, size).alias("p")).select("id", "row_key", "p.*"))
    each = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.max("n_shingles").alias("n_shingles")))
    roots = components(linked(each.select("fp", "n_shingles"), radius, tile))
    named = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("id", "row_key", "fp", "root", "component_id")


def set_print(grams: np.ndarray, words: int = 4) -> np.ndarray:
    """The fingerprint words of a set, each of its members once."""
    counts = np.zeros(64 * words, dtype=np.int64)
    for start in range(0, len(grams), 16384):
        counts += _bits(grams[start:start + 16384], words).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(grams), bitorder="little").view("<u8")


def bare(text: str) -> Column:
    """The text without ASCII punctuation; null is empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.punctuation, "")


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def _units(size: int):
    """``id, row_key, mark, unit, fp, n_shingles`` of each text, and ``hash, df`` of members that are frequent among the sets of the partition."""

    def frequent(parts: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        h, n = h[n > 2], n[n > 2]
        none = [pa.nulls(len(h), t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known, parts, held = Shingler(size), {}, [], 0
        for batch in batches:
            units, prints, n = [], [], []
            for grams in shingler.sets(batch.column(3)):
                unit = _signed(HASH(grams.tobytes()))
                if unit not in known:
                    known[unit] = set_print(grams).view(np.int64).tolist()
                    parts.append(grams)
                    held += len(grams)
                units.append(unit)
                prints.append(known[unit])
                n.append(len(grams))
                if held > FLUSH:
                    yield frequent(parts, batch.column(0).type)
                    known, parts, held = {}, [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(units, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(n, pa.int64()),
                                              none, none], names=UNIT)
        if held:
            yield frequent(parts, batch.column(0).type)

    return run


UNIT = ["id", "row_key", "mark", "unit", "fp", "n_shingles", "hash", "df"]


def _prefixes(size: int, similarity: float, common: np.ndarray):
    """``unit, key``: the prefix of each set, members of the ``common`` table last and the most frequent of them very last."""
    by_hash = np.argsort(common)
    in_order = common[by_hash]

    def rank(grams: np.ndarray) -> np.ndarray:
        if not len(common):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(in_order, grams), len(common) - 1)
        return np.where(in_order[at] == grams, len(common) - by_hash[at], 0)

    def made(units: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        unit = np.repeat(np.array(units, np.int64), [len(k) for k in keys])
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(key.view(np.int64))], names=["unit", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for batch in batches:
            units, keys, held = [], [], 0
            for grams in shingler.sets(batch.column(0)):
                unit = _signed(HASH(grams.tobytes()))
                if not len(grams) or unit in seen:
                    continue
                seen.add(unit)
                units.append(unit)
                keys.append(grams[np.lexsort((grams, rank(grams)))[:len(grams) - math.ceil(similarity * len(grams) - 1e-9) + 1]])
                held += len(keys[-1])
                if held > FLUSH // 4:
                    yield made(units, keys)
                    units, keys, held = [], [], 0
            yield made(units, keys)
            if len(seen) > FLUSH:
                seen = set()

    return run


def _sets_of(texts: DataFrame, size: int, need: DataFrame) -> DataFrame:
    """``unit``, ``grams`` of the texts (columns ``mark``, ``text``) whose mark may be among those of ``need``."""
    bits = fitting_bits(need, "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for batch in batches:
            batch = batch.filter(pa.array(bits.hits(batch.column(0).to_numpy())))
            units, held, bytes_held = [], [], 0
            for grams in shingler.sets(batch.column(1)):
                unit = _signed(HASH(grams.tobytes()))
                if unit not in seen:
                    seen.add(unit)
                    units.append(unit)
                    held.append(grams.tobytes())
                    bytes_held += len(held[-1])
                if bytes_held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(held, pa.binary())], names=["unit", "grams"])
                    units, held, bytes_held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(held, pa.binary())], names=["unit", "grams"])
            if len(seen) > FLUSH:
                seen = set()

    return texts.mapInArrow(run, "unit bigint, grams binary").groupBy("unit").agg(F.first("grams").alias("grams"))


def _only(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.hits(batch.column(1).to_numpy())))

    return run


def candidates(texts: DataFrame, each: DataFrame, common: np.ndarray, size: int, similarity: float, radius: int, wide_radius: int, tile: int) -> DataFrame:
    """Links ``u``, ``v`` of units that share a key and whose fingerprints are near: their components hold every pair of this kind."""
    path = shared_folder(texts.sparkSession, "simhash-keys")
    texts.select("text").mapInArrow(_prefixes(size, similarity, common), "unit bigint, key bigint").write.parquet(path)
    keys = texts.sparkSession.read.schema("unit bigint, key bigint").parquet(path)
    shared = cut(keys.groupBy("key").agg(F.min("unit").alias("a"), F.max("unit").alias("b")).where("a < b").select("key"))
    met = keys.mapInArrow(_only(fitting_bits(shared, "key")), "unit bigint, key bigint")
    met = cut(met.join(shared, "key").distinct())
    # Near copies share many keys: buckets with the same units are one.
    about = met.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("unit").alias("a"), F.sum(F.xxhash64("unit").cast("decimal(20,0)")).alias("sum"))
    about = cut(about.groupBy("m", "a", "sum").agg(F.min("key").alias("key")).select("key", "m"))
    rows = met.join(about, "key").join(each.select("unit", "fp", "n_shingles"), "unit")
    rows = cut(rows.select(F.lit(0).alias("t"), "key", F.lit(True).alias("home"), "unit", "fp", "n_shingles", "m"))
    small = rows.where(F.col("m") <= tile).drop("m").withColumn("tile", F.lit(-1).cast("long"))
    large = _tiles(rows.where(F.col("m") > tile).drop("m"), radius, tile)
    return _in_tiles(small.unionByName(large), [radius, wide_radius], similarity, "unit").distinct()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least the limit."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _verify(similarity: float, wide_radius: int):
    """Rows of one block pair of a candidate component in, a spanning forest of the exact links out."""

    def run(table: pa.Table) -> pa.Table:
        fp = np.array(table.column("fp").to_pylist(), dtype=np.int64).view(np.uint64).reshape(table.num_rows, -1)
        sets = [np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()]
        n = np.array([len(g) for g in sets])
        units, up = table.column("unit").to_pylist(), list(range(len(sets)))
        out: list[tuple[int, int]] = []

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in range(len(sets)):
            near = np.bitwise_count(fp[i] ^ fp[:i]).sum(axis=1, dtype=np.int64) <= wide_radius
            near &= np.minimum(n[i], n[:i]) >= similarity * np.maximum(n[i], n[:i]) - 1e-9
            for j in np.flatnonzero(near).tolist():
                x, y = root(i), root(j)
                if x != y and similar(sets[i], sets[j], similarity):
                    up[max(x, y)] = min(x, y)
                    out.append((units[i], units[j]))
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return run


def jaccard_links(texts: DataFrame, each: DataFrame, found: DataFrame, size: int, similarity: float, wide_radius: int, block: int = 1024) -> DataFrame:
    """Links ``u``, ``v`` of units with exact similarity, a spanning set of those inside the components of ``found``.

    Sets travel only for components of two units or more, and those larger than ``block`` are compared block by block.
    """
    named = components(found).withColumnRenamed("node", "unit").join(each, "unit")
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    need = cut(named.join(sizes, "root").select("root", "m", "fp", "unit", "mark"))
    rows = need.join(_sets_of(texts, size, need), "unit")
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / block)).withColumn("mine", F.pmod(F.xxhash64("unit"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    return rows.select("root", "low", "high", "fp", "unit", "grams").groupBy("root", "low", "high").applyInArrow(
        _verify(similarity, wide_radius), "u bigint, v bigint")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8,
             radius: int = 32, wide_radius: int = 85, tile: int = TILE) -> DataFrame:
    """One row of each group of near-duplicates, that with the least id; columns of ``docs``.

    Similarity is that of the sets of bare lower-case shingles, decided exactly.  Sets meet where they share a key, which every similar
    pair does; there fingerprints of four words (256 bits) of the sets tell which pairs are candidates: at Jaccard similarity 0.8 the
    angle is acos(1.6 / 1.8), so 38.6 bits differ on average (deviation 5.7; 48 for four of five shingles), and 9.7 in the first
    word (deviation 2.9).  ``wide_radius`` and ``radius`` lie 5.5 deviations or more above both.  Texts of one set are one unit.
    Texts without any word share a group.  Rows with equal id and text are one document: the first
    by a hash of their other columns stays.
    """
    small_batches(docs.sparkSession)
    group, key, order, own = (spare(docs, name) for name in ("group", "row_key", "order", "own_key"))
    texts = docs.select(bare(text).alias("text")).select(F.xxhash64("text").alias("mark"), "text")
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("row_key"), bare(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    both = cut(rows.select("id", "row_key", F.xxhash64("text").alias("mark"), "text").mapInArrow(
        _units(size), f"id {kind}, row_key bigint, mark bigint, unit bigint, fp array<bigint>, n_shingles bigint, hash bigint, df bigint"))
    prints = both.where("unit is not null")
    each = cut(prints.groupBy("unit").agg(F.min("mark").alias("mark"), F.min("fp").alias("fp"), F.min("n_shingles").alias("n_shingles")))
    often = both.where("hash is not null").groupBy("hash").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "hash").limit(COMMON).select("hash").toPandas()
    common = often["hash"].to_numpy(dtype=np.int64).view(np.uint64)
    found = cut(candidates(texts, each, common, size, similarity, radius, wide_radius, tile))
    roots = components(jaccard_links(texts, each, found, size, similarity, wide_radius)).withColumnRenamed("node", "unit")
    named = prints.select("id", "row_key", "unit").join(roots, "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    keep = named.groupBy("root").agg(F.min(F.struct("id", "row_key")).alias("best")).select("best.*").select(
        F.col("id").alias(group), F.col("row_key").alias(key)).distinct()
    rows = docs.withColumn(own, row_key(id_col, text))
    met = rows.join(keep, F.col(id_col).eqNullSafe(F.col(group)) & (F.col(own) == F.col(key)), "left_semi")
    others = [c for c in docs.columns if c not in (id_col, text)]
    place = Window.partitionBy(id_col, own).orderBy(F.xxhash64(*others) if others else F.lit(0))
    return met.withColumn(order, F.row_number().over(place)).where(F.col(order) == 1).select(*docs.columns)
