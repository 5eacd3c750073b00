"""Cross-entropy difference of two matched bigram models.

A target model (of the marked documents) and a background model (of all documents) share the
vocabulary and the interpolation, and differ in their counts only:

    P(w | h) = W * c(h w) / c(h) + (1 - W * [c(h) > 0]) * (c(w) + 1) / (N + V + 1)

so each model sums to one.  Every word and every bigram of the corpus counts, at any size (V words, and one
for those never seen).

``scored`` keeps all counts in Spark.  Documents are dealt to *chunks* of about ``CHUNK`` bytes of text.  A chunk counts its words and
bigrams as 64-bit hashes and sends them, sorted, in one row per *range* of hashes; a range adds the counts of all chunks and sends back
to each chunk one bit per key (has another chunk this key too?) and the sums of those keys; for all others the chunk's own count is the
sum.  A common key so has one entry per chunk and not one per document.  Equal rows of a chunk are counted once with their number.  At ten
million words two share a hash with a chance of 3e-6.  ``train`` and ``score`` hold the same model on the driver, for small tables.

A document's score is the mean over its tokens of (target loss - background loss) in bits: low is
near the target.

Defined cases: null and empty texts have no token and score null; with no marked document, or an empty
corpus, the target counts are zero and only the added ones speak; repeated rows count and score
each by itself; null marks are false; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexflow.llm.ngramjoin import MULTIPLIER, mixed
from simplexflow.llm.tables import Bits, parts_for, spare, split_by
from simplexflow.plans.lineage import cut

#: Number of the line start and of the unknown word.
START, UNKNOWN = 0, 1
FLUSH = 1_000_000
#: Bytes of text in a chunk.
CHUNK = 16 << 20


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of the partition, handed on in parts of bounded size."""
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(tokens(text.as_py()))
            if len(counts) > 200_000:
                yield _words(counts)
                counts = Counter()
    yield _words(counts)


def _words(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def numbers(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Word numbers after a start mark."""
    out = np.empty(len(words) + 1, dtype=np.int64)
    out[0] = START
    out[1:] = [known.get(w, UNKNOWN) for w in words]
    return out


def _count_bigrams(known: dict[bytes, int]):
    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(keys & 1), pa.array(n.astype(np.int64))], names=["bigram", "marked", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for text, mark in zip(batch.column(0), batch.column(1).to_pylist()):
                ids = numbers(tokens(text.as_py()), known)
                parts.append(((ids[:-1] << 31 | ids[1:]) << 1) | int(bool(mark)))
                size += len(ids)
                if size > FLUSH:
                    yield counted(parts)
                    parts, size = [], 0
        yield counted(parts)

    return run


@dataclass
class Side:
    """Counts of one model: of words, of histories, of kept bigrams and their sum per history."""

    word: np.ndarray
    history: np.ndarray
    kept: np.ndarray
    kept_of: np.ndarray

    def loss(self, h: np.ndarray, w: np.ndarray, at: np.ndarray, found: np.ndarray, weight: float) -> np.ndarray:
        base = (self.word[w] + 1) / (self.word.sum() + len(self.word) - 1)  # the start mark is never predicted
        c = np.maximum(self.history[h], 1)
        p = weight * np.where(found, self.kept[at], 0) / c + (1 - weight * self.kept_of[h] / c) * base
        return -np.log2(p)


@dataclass
class Models:
    known: dict[bytes, int]
    bigrams: np.ndarray
    target: Side
    background: Side
    weight: float

    def score(self, text: str | None) -> tuple[int, float | None, float | None]:
        """Tokens, and the mean losses per token of target and background."""
        ids = numbers(tokens(text), self.known)
        if len(ids) == 1:
            return 0, None, None
        h, w = ids[:-1], ids[1:]
        key = h << 31 | w
        at = np.minimum(np.searchsorted(self.bigrams, key), max(0, len(self.bigrams) - 1))
        found = self.bigrams[at] == key if len(self.bigrams) else np.zeros(len(key), bool)
        at = at if len(self.bigrams) else np.zeros(len(key), np.int64)
        return len(w), *(float(side.loss(h, w, at, found, self.weight).mean()) for side in (self.target, self.background))


def _side(size: int, bigrams: np.ndarray, kept: np.ndarray, singles: list, marked: bool) -> Side:
    """``singles``: rows of word number, count as history and as word, of all and of marked documents."""
    history, word = np.zeros(size), np.zeros(size)
    for number, h, w, hm, wm in singles:
        history[number], word[number] = (hm, wm) if marked else (h, w)
    kept = kept.astype(float) if len(kept) else np.zeros(1)
    kept_of = np.zeros(size)
    if len(bigrams):
        np.add.at(kept_of, bigrams >> 31, kept)
    return Side(word, history, kept, kept_of)


def marked(docs: DataFrame, ids: DataFrame, mark: str, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with a boolean column: whether the id is among ``ids`` (one column of that name).

    Only rows that may be among them are shuffled, at every size, and a null id is not.
    """
    key, own = spare(docs, "id_key"), spare(docs, mark + "_id")
    some = ids.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias(own)).distinct()
    near, far = split_by(docs.withColumn(key, F.xxhash64(doc_id)), key, Bits(some.withColumn(key, F.xxhash64(own)), key))
    near = near.join(some.hint("merge"), F.col(doc_id) == F.col(own), "left").withColumn(mark, F.col(own).isNotNull())
    return near.select(*docs.columns, mark).unionByName(far.withColumn(mark, F.lit(False)).select(*docs.columns, mark))


def train(docs: DataFrame, mark: str, text: str = "text", min_share: int | None = None, weight: float = 0.6, whole: DataFrame | None = None) -> Models:
    """Both models from ``docs``, on the driver; ``mark`` names the boolean column of target documents.

    Only with ``min_share`` are words and bigrams below ``1 / min_share`` of all left out.

    ``whole`` may give the same rows without the mark, where making the mark costs a shuffle.
    """
    counted = (docs if whole is None else whole).select(text).mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = lambda all_: F.lit(True) if min_share is None else F.col("n") * min_share >= all_
    words = [bytes(r["word"]) for r in counted.where(often(total)).select("word").collect()]
    known = {w: i for i, w in enumerate(sorted(words), 2)}
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(mark), F.lit(False)).alias("mark"))
    pairs = rows.mapInArrow(_count_bigrams(known), "bigram bigint, marked bigint, n bigint").groupBy("bigram").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("marked")).alias("m"))
    pairs = cut(pairs)
    h, w = F.shiftright("bigram", 31), F.col("bigram").bitwiseAND(F.lit((1 << 31) - 1))
    singles = pairs.select(F.explode(F.array(
        F.struct(h.alias("number"), F.col("n").alias("h"), F.lit(0).cast("bigint").alias("w"), F.col("m").alias("hm"), F.lit(0).cast("bigint").alias("wm")),
        F.struct(w.alias("number"), F.lit(0).cast("bigint").alias("h"), F.col("n").alias("w"), F.lit(0).cast("bigint").alias("hm"), F.col("m").alias("wm")),
    )).alias("s")).select("s.*").groupBy("number").agg(*[F.sum(c).alias(c) for c in ("h", "w", "hm", "wm")])
    singles = [(r["number"], r["h"], r["w"], r["hm"], r["wm"]) for r in singles.collect()]  # one row per known word
    n_pairs = sum(s[1] for s in singles)
    kept = pairs.where(often(n_pairs)).toPandas().sort_values("bigram")
    size = len(known) + 2
    bigrams = kept["bigram"].to_numpy(dtype=np.int64)
    return Models(known, bigrams, _side(size, bigrams, kept["m"].to_numpy(), singles, True),
                  _side(size, bigrams, kept["n"].to_numpy(), singles, False), weight)


def score(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            rows = [held.score(t.as_py()) for t in batch.column(1)]
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.float64()), pa.array(b, pa.float64())],
                                             names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    fields = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double"
    out = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields)
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, first all their low bytes, then the next ones and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


#: Places in each chunk's table of words: the start of a text, and one that counts all tokens.
FIRST, TOTAL = 0, 1
#: Counts of a word: as word and as history, of all and of marked texts; of a bigram: of all and of marked texts.
WORDS, BIGRAMS = 0, 1


@dataclass
class Chunk:
    """Texts of one chunk as places in sorted tables of words and bigrams, which follow from the chunk's texts alone."""

    lengths: np.ndarray
    times: np.ndarray
    words: np.ndarray
    w: np.ndarray
    h: np.ndarray
    bigrams: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Chunk:
        """``table``: columns ``text`` and ``times``, how often the row occurs."""
        known: dict[bytes, int] = {}
        number = known.setdefault
        parts = [np.array([number(w, len(known)) for w in tokens(t.as_py())], dtype=np.int32) for t in table.column("text")]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))
        hashes[hashes <= TOTAL] += np.uint64(2)
        words, place = np.unique(np.concatenate([np.array([FIRST, TOTAL], np.uint64), hashes]), return_inverse=True)
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        w = place[2:][np.concatenate([*parts, np.zeros(0, np.int32)])]
        h = np.roll(w, 1)
        h[(np.cumsum(lengths) - lengths)[lengths > 0]] = FIRST
        bigrams, at = np.unique(mixed(mixed(words[h]) * MULTIPLIER + words[w]), return_inverse=True)
        return cls(lengths, table.column("times").to_numpy(), words, w, h, bigrams, at)

    def keys(self, kind: int) -> np.ndarray:
        return self.words if kind == WORDS else self.bigrams

    def counts(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words (rows: word, history, marked word, marked history) and of bigrams (rows: all, marked)."""
        words, bigrams = [], []
        for times in (self.times, self.times * mark):
            each = np.repeat(times, self.lengths).astype(float)
            words += [np.bincount(x, each, len(self.words)) for x in (self.w, self.h)]
            words[-2][TOTAL] = each.sum()
            bigrams.append(np.bincount(self.at, each, len(self.bigrams)))
        return np.array(words).astype(np.int64), np.array(bigrams).astype(np.int64)

    def losses(self, word: np.ndarray, history: np.ndarray, bigram: np.ndarray, n_words: int, weight: float) -> np.ndarray:
        """Mean loss of each text under the model with these sums."""
        c = history[self.h]
        base = (word[self.w] + 1) / (word[TOTAL] + n_words + 1)
        loss = -np.log2(weight * bigram[self.at] / np.maximum(c, 1) + (1 - weight * (c > 0)) * base)
        of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.bincount(of, loss, len(self.lengths)) / np.maximum(self.lengths, 1)


def _ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Numbers of the ranges of hashes that have keys, with their first and last place; 2 ** bits ranges in all."""
    number = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(keys) else np.zeros(0, np.int64)
    yield from zip(number[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)])


SENT = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _chunk_counts(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk = Chunk.of(table)
        rows = []
        for kind, counts in zip((WORDS, BIGRAMS), chunk.counts(table.column("mark").to_numpy())):
            keys = chunk.keys(kind)
            for number, lo, hi in _ranges(keys, bits):
                rows.append((key[0].as_py(), kind, number, packed(np.diff(keys[lo:hi], prepend=np.uint64(0))), packed(counts[:, lo:hi])))
        return pa.Table.from_pydict(dict(zip(SENT.names, zip(*rows))) if rows else {n: [] for n in SENT.names}, schema=SENT)

    return run


def _range_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Blocks of one range in; for each, which of its keys others have too, and the sums of these."""
    blocks = [np.cumsum(unpacked(b, np.uint64), dtype=np.uint64) for b in table.column("keys").to_pylist()]
    ends = np.cumsum([len(b) for b in blocks])
    counts = np.concatenate([unpacked(c).reshape(-1, len(b)) for c, b in zip(table.column("counts").to_pylist(), blocks)], axis=1)
    found, at, often = np.unique(np.concatenate(blocks), return_inverse=True, return_counts=True)
    sums = np.array([np.bincount(at, c, len(found)) for c in counts]).astype(np.int64)
    shared, sent = [], []
    for lo, hi in zip(ends - [len(b) for b in blocks], ends):
        own = at[lo:hi]
        hit = often[own] > 1
        shared.append(np.packbits(hit).tobytes())
        sent.append(packed(sums[:, own[hit]]))
    return table.select(["chunk", "kind", "range"]).append_column("keys", pa.array(shared, pa.binary())).append_column("counts", pa.array(sent, pa.binary()))


def source_split() -> Column:
    """Names the part of the file that a row is read from: rows of a hot text then go to a chunk for each part."""
    return F.xxhash64(F.input_file_name(), F.input_file_block_start())


def scored(docs: DataFrame, mark: str, doc_id: str = "doc_id", text: str = "text", weight: float = 0.6, whole: DataFrame | None = None,
           chunk: int = CHUNK, split: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` of every row under the models of all rows.

    ``whole`` may give the same rows without the mark, where making the mark costs a shuffle.  ``split`` may name a column of
    ``source_split()``, made before any shuffle.
    """
    whole = (docs if whole is None else whole).select(F.col(text).alias("text"))
    n_chunks = parts_for(whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0, chunk)
    n_words = whole.mapInArrow(_count_words, "word binary, n bigint").select(F.xxhash64("word")).distinct().count()
    bits = n_chunks.bit_length()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(mark), F.lit(False)).alias("mark"),
                       F.col(split).alias("split") if split else F.lit(0).cast("bigint").alias("split"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", "split"), F.lit(n_chunks).cast("bigint"))).drop("split")
    rows = rows.repartition("chunk").groupBy("chunk", "doc_id", "text", "mark").agg(F.count(F.lit(1)).alias("times"))
    kinds = "chunk bigint, kind int, range bigint, keys binary, counts binary"
    sent = rows.groupBy("chunk").applyInArrow(_chunk_counts(bits), kinds)
    sums = sent.groupBy("kind", "range").applyInArrow(_range_sums, kinds)

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        held = Chunk.of(table)
        words, bigrams = held.counts(table.column("mark").to_numpy())
        places = {(kind, number): slice(lo, hi) for kind in (WORDS, BIGRAMS) for number, lo, hi in _ranges(held.keys(kind), bits)}
        for kind, number, shared, counts in zip(*(back.column(c).to_pylist() for c in ("kind", "range", "keys", "counts"))):
            own = (words, bigrams)[kind][:, places[kind, number]]
            hit = np.unpackbits(np.frombuffer(shared, np.uint8), count=own.shape[1]).astype(bool)
            own[:, hit] = unpacked(counts).reshape(len(own), -1)
        none = held.lengths == 0
        losses = [pa.array(held.losses(words[i], words[i + 1], bigrams[i // 2], n_words, weight), mask=none) for i in (2, 0)]
        return pa.table([table.column("doc_id"), pa.array(held.lengths), *losses, table.column("times")], names=names)

    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "times"]
    fields = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, times bigint"
    out = rows.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(run, fields)
    out = out.withColumn("times", F.explode(F.expr("sequence(1L, times)"))).drop("times")
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
