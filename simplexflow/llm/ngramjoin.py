"""N-gram Jaccard join with an R-tree over count vectors.

A text's set holds the hashes of its distinct word shingles.  Every set is a point: its members are hashed into
groups (``GROUPS``, or more for larger sets), and the group counts are the coordinates.  The overlap of two sets is at most the sum of the coordinate minima,
and that of a set with all points of a box at most the sum of the minima with the box's upper corner; so an R-tree whose boxes
know their upper corner and range of sizes finds all points that may reach the similarity.  Survivors are verified on the sets.

The trees work inside neighbourhoods that lose no pair, in three steps:

1. *Keys.*  Two sets of Jaccard similarity s or more share one of the first n - ceil(s n) + 1 members of either in any common order.
   The order puts hashes that are frequent inside partitions last (a table of at most ``COMMON`` hashes; it decides about work only).
   Equal sets are one unit.  Keys that more than one unit has are neighbourhoods.
2. *Candidates.*  In a neighbourhood the R-tree gives the pairs whose bound reaches the limit, as a spanning forest.  A neighbourhood
   of more than ``TILE`` units joins each unit to the least unit of its size class and of the next one instead, by aggregates:
   that may only add candidates.
3. *Verification.*  The components of the candidates hold all links.  Their sets are read once more from the texts; a component is one group,
   or dealt to chunks of about ``TILE`` units.  Every chunk also gets the component's least ``LEADERS`` units, so near copies of one text are
   one cluster after this.  Units outside the largest cluster of their component then meet every chunk, in blocks of a tile.  In each group an
   R-tree over its points gives the pairs of different clusters to verify, and only links that join clusters come back.

Defined cases: a text without words (null or empty too) has no shingle and no link; a text with fewer words than a shingle is one
shingle; equal texts and repeated rows are one unit; null ids never name a component unless all its ids are null; an empty
table gives an empty table; other columns are not read.  Sets are told apart by 64-bit hashes (for 256,000 texts two meet
with a chance of 2e-9).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexflow.llm.components import components
from simplexflow.llm.tables import Bits, shared_folder
from simplexflow.plans.lineage import cut

SIZE, LIMIT = 5, (80, 100)
GROUPS, FAN, TILE, LEADERS = 64, 16, 1024, 16
#: Mean members of a unit up to which a chunk may have ``TILE`` units.
MEMBERS = 2048
COMMON = 1 << 18
#: Members of the sets that a task counts before it hands on the frequent ones.
FLUSH = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of result that a task hands on at once.
PART = 1 << 22
#: Bytes of text whose words are hashed together.
BLOCK = 1 << 19
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: A value for each byte, with A-Z as a-z.
VALUE = mixed(np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8).astype(np.uint64) + np.uint64(1))


class Shingler:
    """Sets of shingle hashes of many texts at once, by rolling sums over their UTF-8 bytes."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, MULTIPLIER)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE)], dtype=np.uint64)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The distinct hashes of each text in rising order; words end at ASCII white space and A-Z are lower-cased."""
        if not len(texts):
            return
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
            yield from self._block(data[ends[at]:ends[to]], ends[at:to + 1] - ends[at])
            at = to

    def _block(self, data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        self._powers(len(data) + 1)
        border = np.zeros(len(data) + 1, bool)  # a text starts here
        border[ends] = True
        word = np.r_[False, ~SPACE[data], False]
        start = np.flatnonzero(word[1:-1] & (~word[:-2] | border[:-1]))
        end = np.flatnonzero(word[1:-1] & (~word[2:] | border[1:])) + 1
        sums = np.r_[np.uint64(0), np.cumsum(VALUE[data] * self.up[:len(data)], dtype=np.uint64)]
        hashes = mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))
        text = np.searchsorted(ends, start, "right") - 1  # of empty texts before a start the last one is the text's
        n_words = np.bincount(text, minlength=len(ends) - 1)
        first = np.cumsum(n_words) - n_words
        n_grams = np.where(n_words >= self.size, n_words - self.size + 1, np.minimum(n_words, 1))
        to = np.cumsum(n_grams)
        grams = np.empty(int(to[-1]) if len(to) else 0, np.uint64)
        spot = np.repeat(first - to + n_grams, n_grams) + np.arange(len(grams))  # first word of each shingle
        many = np.repeat(np.minimum(n_words, self.size), n_grams)
        made = many.astype(np.uint64)
        for i in range(self.size):
            more = hashes[np.minimum(spot + i, len(hashes) - 1)] if len(hashes) else hashes
            made = np.where(i < many, made * MULTIPLIER + more, made)
        grams = mixed(made)
        for lo, hi in zip((to - n_grams).tolist(), to.tolist()):
            own = grams[lo:hi]
            own.sort()
            yield own[np.r_[True, own[1:] != own[:-1]]] if hi - lo > 1 else own


def unit_of(grams: np.ndarray) -> int:
    """The 64-bit name of a set, signed."""
    h = xxhash.xxh64_intdigest(grams.tobytes(), 7)
    return h - (h >> 63 << 64)


def counts_of(grams: np.ndarray) -> np.ndarray:
    """The point of a set: how many members each group has.

    The groups are a power of two, ``GROUPS`` or an eighth of the members at least: the counts of unrelated sets of n members
    differ by about 1.1 * sqrt(n * groups), those of similar ones by n / 4.5 at most.
    """
    groups = max(GROUPS, 1 << (max(len(grams) - 1, 1) // 8).bit_length())
    return np.bincount((grams & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def levels(points: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of groups: the rows that can meet, their points with that number, and which rows are of it.

    Sizes of similar sets are within a factor of two, so a row meets rows of its own and of the next number, folded.
    """
    groups = np.array([len(p) for p in points])
    for g in np.unique(groups).tolist():
        rows = np.flatnonzero((groups == g) | (groups == 2 * g))
        yield rows, np.stack([points[r].reshape(-1, g).sum(axis=0, dtype=np.int32) for r in rows]), groups[rows] == g


def prefix_length(n: int, limit: tuple[int, int]) -> int:
    """Members of which similar sets must share one: n - ceil(s n) + 1."""
    return n + limit[0] * -n // limit[1] + 1


def reaches(overlap, a, b, limit: tuple[int, int]):
    """Whether sets of sizes a and b with this overlap have the similarity, in whole numbers."""
    return (limit[0] + limit[1]) * overlap >= limit[0] * (a + b)


class CountTree:
    """A packed R-tree over count vectors.

    Points are packed by size and, inside slabs of equal number, by the coordinate that varies most.  A box has the upper
    corner and the least and greatest size of ``FAN`` boxes (or points) below it.
    """

    def __init__(self, points: np.ndarray, limit: tuple[int, int] = LIMIT, fan: int = FAN):
        self.limit, self.fan = limit, fan
        n = points.sum(axis=1, dtype=np.int64)
        slabs = max(1, int(np.sqrt(len(points) / fan)))
        slab = np.empty(len(points), np.int64)
        slab[np.argsort(n, kind="stable")] = np.arange(len(points)) * slabs // max(1, len(points))
        spread = points[:, points.var(axis=0).argmax()] if len(points) else n
        self.order = np.lexsort((spread, slab))
        self.upper, self.least, self.most = [points[self.order]], [n[self.order]], [n[self.order]]
        while len(self.upper[-1]) > fan:
            starts = np.arange(0, len(self.upper[-1]), fan)
            self.upper.append(np.maximum.reduceat(self.upper[-1], starts))
            self.least.append(np.minimum.reduceat(self.least[-1], starts))
            self.most.append(np.maximum.reduceat(self.most[-1], starts))

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose bound reaches the limit; boxes are left as soon as theirs does not."""
        n = points.sum(axis=1, dtype=np.int64)
        query = np.repeat(np.arange(len(points)), len(self.upper[-1]))
        box = np.tile(np.arange(len(self.upper[-1])), len(points))
        for level in range(len(self.upper) - 1, -1, -1):
            kept = []
            step = max(1, (1 << 21) // points.shape[1])
            for at in range(0, len(query), step):
                q, b = query[at:at + step], box[at:at + step]
                a, low, high = n[q], self.least[level][b], self.most[level][b]
                some = np.flatnonzero(reaches(np.minimum(a, high), a, low, self.limit))
                q, b = q[some], b[some]
                bound = np.minimum(points[q], self.upper[level][b]).sum(axis=1, dtype=np.int64)
                some = np.flatnonzero(reaches(bound, a[some], low[some], self.limit))
                kept.append((q[some], b[some]))
            query, box = (np.concatenate(x) if kept else np.zeros(0, np.int64) for x in (zip(*kept) if kept else ((), ())))
            if level:
                below = len(self.upper[level - 1])
                box = (box[:, None] * self.fan + np.arange(self.fan)).ravel()
                query = np.repeat(query, self.fan)
                query, box = query[box < below], box[box < below]
        return query, self.order[box]


class Clusters:
    """Union-find with the members' roots as an array."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, j: int) -> bool:
        a, b = self.label[i], self.label[j]
        if a == b:
            return False
        self.label[self.label == max(a, b)] = min(a, b)
        return True


def near_pairs(points: list[np.ndarray], clusters: Clusters, limit: tuple[int, int], asks: np.ndarray | None = None,
               same: Callable[[int, int], bool] | None = None, step: int = 128) -> list[tuple[int, int]]:
    """Pairs that join clusters: bound by a tree and, with ``same``, verified.  ``asks``: at least one row of a pair is marked so."""
    out = []
    for rows, level, own in levels(points):
        tree = CountTree(level, limit)
        queries = np.flatnonzero(own)
        for at in range(0, len(queries), step):
            some = queries[at:at + step]
            q, p = tree.search(level[some])
            order = np.lexsort((p, q))
            q, p = q[order], p[order]
            starts = np.searchsorted(q, np.arange(len(some) + 1))
            for k, mine in enumerate(some.tolist()):
                met = p[starts[k]:starts[k + 1]]
                met = rows[met[(met < mine) | ~own[met]]]
                i = int(rows[mine])
                if asks is not None and not asks[i]:
                    met = met[asks[met]]
                while len(met := met[clusters.label[met] != clusters.label[i]]):
                    j = int(met[0])
                    met = met[1:]
                    if same is None or same(i, j):
                        clusters.join(i, j)
                        out.append((i, j))
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal integer ``keys`` of sorted partitions, one at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in keys])
        borders = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(borders, borders[1:]):
            if held and tuple(key[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(key[lo])
    if held:
        yield pa.Table.from_batches(held)


def _units(size: int):
    """``id, mark, unit, n`` of each text, and ``hash, df`` of hashes that are frequent among the partition's sets."""

    def frequent(parts: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        h, n = h[n > 2], n[n > 2]
        none = [pa.nulls(len(h), t) for t in (kind, pa.int64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, parts, held = Shingler(size), set(), [], 0
        for batch in batches:
            units, n = [], []
            for grams in shingles.sets(batch.column(2)):
                units.append(unit_of(grams))
                n.append(len(grams))
                if units[-1] not in seen:
                    seen.add(units[-1])
                    parts.append(grams)
                    held += len(grams)
                if held > FLUSH:
                    yield frequent(parts, batch.column(0).type)
                    seen, parts, held = set(), [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.int64()), pa.array(n, pa.int64()), none, none], names=UNIT)
        if held:
            yield frequent(parts, batch.column(0).type)

    return run


UNIT = ["id", "mark", "unit", "n", "hash", "df"]


def _keys(size: int, limit: tuple[int, int], common: np.ndarray):
    """``unit, key``: the prefix of each set, rare hashes first; equal sets of a partition once."""
    by_hash = np.argsort(common)
    sorted_common = common[by_hash]

    def rank(grams: np.ndarray) -> np.ndarray:
        if not len(common):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(sorted_common, grams), len(common) - 1)
        return np.where(sorted_common[at] == grams, len(common) - by_hash[at], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(size), set()
        for batch in batches:
            units, keys, made = [], [], 0
            for grams in shingles.sets(batch.column(0)):
                unit = unit_of(grams)
                if len(grams) and unit not in seen:
                    seen.add(unit)
                    p = prefix_length(len(grams), limit)
                    keys.append(grams[np.lexsort((grams, rank(grams)))[:p]] if len(grams) > 1 else grams)
                    units.append(np.full(len(keys[-1]), unit))
                    made += p
                if made > PART // 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(units)), pa.array(np.concatenate(keys).view(np.int64))], names=["unit", "key"])
                    units, keys, made = [], [], 0
            if units:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(units)), pa.array(np.concatenate(keys).view(np.int64))], names=["unit", "key"])
            if len(seen) > 1_000_000:
                seen = set()

    return run


def _read_again(docs: DataFrame, units: DataFrame, text: str, size: int, as_points: bool) -> DataFrame:
    """``unit, held`` of (at least) ``units``: the point or the whole set, as bytes; only texts whose hash ``mark`` may be theirs are worked on."""
    bits = fitting_bits(units, "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(size), set()
        for batch in batches:
            batch = batch.filter(pa.array(bits.hits(batch.column(0).to_numpy())))
            units, held, bytes_held = [], [], 0
            for grams in shingles.sets(batch.column(1)):
                unit = unit_of(grams)
                if unit not in seen:
                    seen.add(unit)
                    units.append(unit)
                    held.append((counts_of(grams) if as_points else grams).tobytes())
                    bytes_held += len(held[-1])
                if bytes_held > PART:
                    yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(held, pa.binary())], names=["unit", "held"])
                    units, held, bytes_held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(held, pa.binary())], names=["unit", "held"])
            if len(seen) > 1_000_000:
                seen = set()

    found = docs.select(F.xxhash64(text).alias("mark"), text).mapInArrow(run, "unit bigint, held binary")
    return found.groupBy("unit").agg(F.first("held").alias("held"))


def fitting_bits(keys: DataFrame, key: str) -> Bits:
    """A bit table of sixteen bits a key, up to 32 MB; larger sets of keys are thinned out less, never wrongly."""
    n = keys.count()
    return Bits(keys, key, 1 << min(28, max(16, (16 * n).bit_length())))


def _pairs_of(limit: tuple[int, int]):
    """Neighbourhoods in, forests of pairs within the bound out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in groups(batches, ["key"]):
            if rows.num_rows < 2:
                continue
            units = rows.column("unit").to_numpy()
            points = [np.frombuffer(x, dtype=np.int32) for x in rows.column("held").to_pylist()]
            if len(units) == 2:
                g = min(map(len, points))
                a, b = (x.reshape(-1, g).sum(axis=0) for x in points)
                if reaches(np.minimum(a, b).sum(), a.sum(), b.sum(), limit):
                    out.append((units[0], units[1]))
            else:
                out += [(units[i], units[j]) for i, j in near_pairs(points, Clusters(units), limit)]
            if len(out) > 20_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["u", "v"])


def _verified(limit: tuple[int, int], keys: list[str]):
    """Groups of sets in, links between different clusters out.  Rows with ``asks`` are the queries, against all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in groups(batches, keys):
            units = rows.column("unit").to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("held").to_pylist()]
            points = [counts_of(s) for s in sets]
            asks = rows.column("asks").to_numpy(zero_copy_only=False)

            def same(i: int, j: int, sets=sets) -> bool:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return bool(reaches(both, len(sets[i]), len(sets[j]), limit))

            found = near_pairs(points, Clusters(rows.column("cluster").to_numpy()), limit, asks, same)
            out += [(units[i], units[j]) for i, j in found]
        yield _links(out)

    return run


def _check(rows: DataFrame, keys: list[str], limit: tuple[int, int]) -> DataFrame:
    rows = rows.select(*keys, "unit", "held", "cluster", "asks").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_verified(limit, keys), "u bigint, v bigint")


def candidates(docs: DataFrame, units: DataFrame, common: np.ndarray, text: str, size: int, limit: tuple[int, int], tile: int) -> DataFrame:
    """Pairs ``u, v`` of units whose components hold all links (steps 1 and 2)."""
    path = shared_folder(docs.sparkSession, "ngram-keys")
    docs.select(text).mapInArrow(_keys(size, limit, common), "unit bigint, key bigint").write.parquet(path)
    keys = docs.sparkSession.read.schema("unit bigint, key bigint").parquet(path)
    shared = keys.groupBy("key").agg(F.min("unit").alias("a"), F.max("unit").alias("b")).where("a < b").select("key")
    shared = cut(shared)
    bits = fitting_bits(shared, "key")
    thinned = keys.mapInArrow(_only(bits), "unit bigint, key bigint")
    met = cut(thinned.join(shared, "key").distinct())
    # Neighbourhoods with the same units are one: near copies share many keys.
    about = met.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("unit").alias("a"), F.sum(F.xxhash64("unit").cast("decimal(20,0)")).alias("sum"))
    about = cut(about.groupBy("m", "a", "sum").agg(F.min("key").alias("key")).select("key", "m"))
    met = met.join(about, "key")
    small = cut(met.where(F.col("m") <= tile).select("key", "unit"))
    points = _read_again(docs, small.select("unit").distinct().join(units, "unit"), text, size, True)
    near = small.join(points, "unit").select("key", "unit", "held").repartition("key").sortWithinPartitions("key").mapInArrow(_pairs_of(limit), "u bigint, v bigint")
    step = float(np.log(limit[1] / limit[0]))
    large = met.where(F.col("m") > tile).join(units.select("unit", "n"), "unit").withColumn("class", F.floor(F.log("n") / step))
    large = large.select("key", "unit", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    heads = large.groupBy("key", "class").agg(F.min("unit").alias("v"))
    stars = large.join(heads, ["key", "class"]).where("unit <> v").select(F.col("unit").alias("u"), "v")
    return near.unionByName(stars).distinct()


def _only(bits: Bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.hits(batch.column(1).to_numpy())))

    return run


def links(docs: DataFrame, units: DataFrame, found: DataFrame, text: str, size: int, limit: tuple[int, int], tile: int) -> DataFrame:
    """Exact links ``u, v`` inside the components of ``found``: a spanning set of all links (step 3)."""
    named = components(found).withColumnRenamed("node", "unit")
    named = cut(named.join(units.select("unit", "n", "mark"), "unit"))
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("members"))
    chunks = F.ceil(F.greatest(F.col("m") / tile, F.col("members") / (tile * MEMBERS))).cast("bigint")
    named = named.join(sizes, "root").select("unit", "root", "mark", chunks.alias("chunks"), F.pmod(F.xxhash64("unit"), chunks).alias("chunk"))
    named = cut(named)
    sets = _read_again(docs, named, text, size, False)
    held = cut(named.drop("mark").join(sets, "unit"))
    leaders = named.where("chunks > 1").groupBy("root").agg(F.slice(F.array_sort(F.collect_set(F.when(F.col("chunk") == 0, F.col("unit")))), 1, LEADERS).alias("heads"))
    leaders = held.join(leaders, "root").where(F.array_contains("heads", F.col("unit"))).drop("heads")
    leaders = leaders.withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("chunks") - 1)))
    plain = {"cluster": F.col("unit"), "asks": F.lit(True)}
    first = cut(_check(held.unionByName(leaders).withColumns(plain), ["root", "chunk"], limit))
    large = cut(held.where("chunks > 1").drop("held"))
    if large.isEmpty():
        return first
    clusters = large.join(components(first).select(F.col("node").alias("unit"), F.col("root").alias("cluster")), "unit", "left")
    clusters = cut(clusters.withColumn("cluster", F.coalesce("cluster", "unit")))
    sizes = clusters.groupBy("root", "cluster").agg(F.count(F.lit(1)).alias("k"))
    most = sizes.groupBy("root").agg(F.max(F.struct("k", "cluster")).alias("most"), F.sum("k").alias("all"))
    open_ = most.where("most.k < all").select("root", F.col("most.cluster").alias("largest"), F.ceil((F.col("all") - F.col("most.k")) / tile).alias("blocks"))
    rows = held.join(clusters.join(open_, "root").select("unit", "cluster", "largest", "blocks"), "unit")
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    points = rows.withColumn("block", blocks).withColumn("asks", F.lit(False))
    outside = rows.where("cluster <> largest").withColumn("block", F.pmod(F.xxhash64("unit", F.lit(1)), "blocks")).withColumn("chunk", chunks)
    met = points.unionByName(outside.withColumn("asks", F.lit(True)))
    return first.unionByName(_check(met, ["root", "chunk", "block"], limit))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, limit: tuple[int, int] = LIMIT, tile: int = TILE) -> DataFrame:
    """``id, n_shingles, root, component_id`` of every document.

    Two documents link when ``limit[1] * intersection >= limit[0] * union`` of their sets; ``component_id`` is the least id of the component.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    both = cut(rows.mapInArrow(_units(size), f"id {kind}, mark bigint, unit bigint, n bigint, hash bigint, df bigint"))
    prints = both.where("unit is not null").select("id", "mark", "unit", "n")
    often = both.where("hash is not null").groupBy("hash").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "hash").limit(COMMON).select("hash").toPandas()
    common = often["hash"].to_numpy(dtype=np.int64).view(np.uint64)
    units = cut(prints.where("n > 0").groupBy("unit").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.min("mark").alias("mark")))
    found = cut(candidates(docs, units, common, text, size, limit, tile))
    exact = links(docs, units, found, text, size, limit, tile)
    named = units.join(components(exact).withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    named = cut(named.select("unit", "least", "root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("unit", "root", "component_id")
    out = prints.join(named, "unit", "left")
    return out.select("id", F.col("n").alias("n_shingles"), "root", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
