"""Packing token sequences: best fit, then swaps that increase the squared fill until bins empty.

A text is split at ASCII white space and each word is encoded once per task while its cache lasts (the tokenizer drops
white space and works word by word, so the ids of a text are those of its words in order).  Arrow splits the texts, numbers
their distinct words and gathers the ids; Python sees each distinct word of about ``GROUP`` bytes once.
Texts longer than a sequence are cut; full pieces are sequences of their own.  All shorter
pieces are dealt by a hash to shards of about ``shard_rows`` rows, whose number grows with the
data; a shard holds lengths only, never text, and wastes at most about one sequence.

In a shard, pieces are placed by best fit in decreasing length.  Then, for underfull
bins from the fullest on, the search exchanges one piece for one, one for two, two for
one, or moves one, between that bin and an emptier one, always the exchange that fills the bin
most.  Each such step takes from an emptier bin and gives to a fuller one, so the sum of squared
fills rises and the search ends; a bin that becomes empty is dropped.

Defined cases: a null text is an empty one (one piece, only the end id); repeated rows are separate
documents; a null id stays null; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import string
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexflow.llm.tables import parts_for
from simplexflow.plans.lineage import cut

#: Words kept by a task (about 200 bytes each).
CACHED_WORDS = 1_000_000


#: Stands between words that are encoded together; a word with this character is encoded alone.
MARK = "\x01"
BATCH = 4000
#: Bytes of text whose words are looked up together.
GROUP = 16 << 20
PUNCTUATION = string.punctuation.encode()


class WordIds:
    """Little-endian 32-bit ids of white-space separated words, with a bounded cache.

    Where the tokenizer takes capitals for small letters and splits letters from ASCII punctuation behind them (both are tried), the
    letters of a word are encoded once for all its spellings.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {b"": b""}
        mark = self.ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.folds = self.ids(string.ascii_uppercase) == self.ids(string.ascii_lowercase)
        self.splits = all(self.ids("ab" + c) == self.ids("ab") + self.ids(c) for c in string.punctuation)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, words: list[bytes]) -> None:
        split, letters, others = [], {}, {}
        for w in words:
            low = w.lower() if self.folds else w
            core = low.rstrip(PUNCTUATION) if self.splits else low
            if core.isalpha() or unicodedata.normalize("NFC", core.decode("utf-8", "replace")).lower().isalpha():
                tail = low[len(core):]
                letters[core] = others[tail] = None
                if core != w:
                    split.append((w, core, tail))
            else:
                others[w] = None
        left = self.learn_letters([w for w in letters if w not in self.known])
        self.learn_marked([w for w in [*left, *others] if w not in self.known])
        for w, core, tail in split:
            self.known[w] = self.known[core] + self.known[tail]

    def learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Learn words of letters, told apart by the tokens that end a word; those of a batch with another number of ends come back."""
        left = []
        for at in range(0, len(words), BATCH):
            some = words[at:at + BATCH]
            ids = np.array(self.ids(b" ".join(some).decode("utf-8")), dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(some) and ends[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends))))
            else:
                left += some
        return left

    def learn_marked(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        together = [i for i, t in enumerate(texts) if MARK not in t and self.mark is not None]
        for at in range(0, len(together), BATCH):
            some = together[at:at + BATCH]
            ids = np.array(self.ids(f" {MARK} ".join(texts[i] for i in some)), dtype="<u4")
            ends = [*(4 * np.flatnonzero(ids == self.mark)).tolist(), 4 * len(ids)]
            if len(ends) == len(some):
                raw, start = ids.tobytes(), 0
                for i, end in zip(some, ends):
                    self.known[words[i]] = raw[start:end]
                    start = end + 4
        for w, t in zip(words, texts):
            if w not in self.known:
                self.known[w] = np.array(self.ids(t), dtype="<u4").tobytes()

    def found(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct words."""
        new = list(itertools.filterfalse(self.known.__contains__, words))
        if len(self.known) + 2 * len(new) > CACHED_WORDS:
            self.known, new = {b"": b""}, words
        self.learn(new)
        return list(map(self.known.__getitem__, words))

    def many(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text; the distinct words of about ``GROUP`` bytes of text are looked up together."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts)).cast(pa.large_string()).fill_null("")
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + GROUP, side="right")) - 1)
            lists = pc.ascii_split_whitespace(texts.slice(at, to - at))
            words = lists.flatten().dictionary_encode()
            ids = pa.array(self.found(words.dictionary.cast(pa.large_binary()).to_pylist()), type=pa.large_binary()).take(words.indices)
            _, ends, raw = ids.buffers()
            ends = np.frombuffer(ends, dtype=np.int64)[lists.offsets.to_numpy()].tolist()
            for start, end in itertools.pairwise(ends):
                yield raw[start:end].to_pybytes() if end > start else b""
            at = to

    def forget(self) -> None:
        self.known = {b"": b""}

    def __call__(self, text: str | None) -> bytes:
        return next(self.many([text]))


_held: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer per worker process; a task empties its cache when it ends, since workers live on in later stages."""
    if path not in _held:
        _held[path] = WordIds(path)
    return _held[path]


PIECES = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])


def _cut_texts(path: str, limit: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = word_ids(path)
        for batch in batches:
            rows = []
            made = held.many(batch.column(2))
            for doc_id, copy, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), made):
                ids = memoryview(raw + end)
                for piece, start in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[start:start + 4 * limit]
                    rows.append((doc_id, copy, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), PIECES)] if rows else
                                             [pa.array([], type=f.type) for f in PIECES], schema=PIECES)
        held.forget()

    return run


def cut_texts(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: ``doc_id, copy, piece, start, length, ids_crc32``; ``copy`` tells equal ids apart."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(text).alias("text"))
    return rows.mapInArrow(_cut_texts(path, limit, end_id), "doc_id bigint, copy bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins (lists of lengths) by best fit in decreasing length; bins are found by free space."""
    by_space: list[list[list[int]]] = [[] for _ in range(limit + 1)]
    spaces: list[int] = []  # free spaces of open bins, sorted and without repeats
    bins = []
    for n in sorted(lengths.tolist(), reverse=True):
        i = bisect_right(spaces, n - 1)
        if i < len(spaces):
            space = spaces[i]
            chosen = by_space[space].pop()
            if not by_space[space]:
                spaces.pop(i)
        else:
            space, chosen = limit, []
            bins.append(chosen)
        chosen.append(n)
        left = space - n
        if left:
            if not by_space[left]:
                insort(spaces, left)
            by_space[left].append(chosen)
    return bins


def exchange(bins: list[list[int]], limit: int, rounds: int = 4) -> list[list[int]]:
    """Local search on underfull bins.

    ``where[n]`` holds the emptier bins with a piece of length n.  For the fullest underfull bin with
    free space g the gain tried is g, then less: a move of a piece of that length, one-for-one
    (b out, b + gain in), two-for-one (b and c out, b + c + gain in) and one-for-two.
    """
    for _ in range(rounds):
        closed = [b for b in bins if sum(b) == limit]
        open_ = sorted((b for b in bins if b and sum(b) < limit), key=sum, reverse=True)
        if len(open_) < 2:
            return closed + open_
        where: list[set[int]] = [set() for _ in range(limit + 1)]
        fill = [sum(b) for b in open_]
        for k, b in enumerate(open_):
            for n in b:
                where[n].add(k)
        changed = 0

        def take(k: int, n: int) -> None:
            open_[k].remove(n)
            fill[k] -= n
            if n not in open_[k]:
                where[n].discard(k)

        def give(k: int, n: int) -> None:
            open_[k].append(n)
            fill[k] += n
            where[n].add(k)

        def other(n: int, k: int, room: int, back: int) -> int | None:
            """An emptier bin than k with a piece n that can take ``back`` instead."""
            if not 0 < n <= limit:
                return None
            for j in where[n]:
                if j != k and fill[j] <= fill[k] and fill[j] - n + back <= limit:
                    return j
            return None

        for k in range(len(open_)):
            tries = 0
            while open_[k] and fill[k] < limit and tries < 8:
                tries += 1
                space = limit - fill[k]
                mine = sorted(set(open_[k]))
                twos = sorted({(a, b) for i, a in enumerate(open_[k]) for b in open_[k][i + 1:]})[:200]
                done = False
                for gain in range(space, 0, -1):
                    j = other(gain, k, space, 0)
                    if j is not None:
                        take(j, gain)
                        give(k, gain)
                        done = True
                        break
                    for b in mine:
                        j = other(b + gain, k, space, b)
                        if j is not None:
                            take(j, b + gain)
                            take(k, b)
                            give(j, b)
                            give(k, b + gain)
                            done = True
                            break
                    if done:
                        break
                    for a, b in twos:
                        j = other(a + b + gain, k, space, a + b)
                        if j is not None:
                            take(j, a + b + gain)
                            take(k, a)
                            take(k, b)
                            give(j, a)
                            give(j, b)
                            give(k, a + b + gain)
                            done = True
                            break
                    if done or gain < space - 64:
                        break
                if not done and open_[k]:
                    for j in range(len(open_) - 1, max(k, len(open_) - 65), -1):  # two of an emptier bin for one
                        pair = next(((b, p, q) for b in mine for i, p in enumerate(open_[j]) for q in open_[j][i + 1:]
                                     if 0 < p + q - b <= space and fill[j] <= fill[k] and fill[j] - p - q + b >= 0), None)
                        if pair:
                            b, p, q = pair
                            take(k, b)
                            take(j, p)
                            take(j, q)
                            give(j, b)
                            give(k, p)
                            give(k, q)
                            done = True
                            break
                if not done:
                    break
                changed += 1
        bins = closed + [b for b in open_ if b]
        if not changed:
            break
    return bins


def pack(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length; equal lengths are served in order."""
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = exchange(best_fit(lengths, limit), limit)
    slots = sorted((n, k) for k, b in enumerate(bins) for n in b)
    order = np.argsort(lengths, kind="stable")
    number = np.empty(len(lengths), np.int64)
    number[order] = [k for _, k in slots]
    by_bin = np.lexsort((-lengths, number))
    ends = np.cumsum(lengths[by_bin])
    starts = ends - lengths[by_bin]
    first = np.flatnonzero(np.r_[True, number[by_bin][1:] != number[by_bin][:-1]])
    offset = np.empty(len(lengths), np.int64)
    offset[by_bin] = starts - np.repeat(starts[first], np.diff(np.r_[first, len(lengths)]))
    return number, offset


def pack_documents(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
                   shard_rows: int = 4000) -> DataFrame:
    """One row per piece with ``sequence_id`` and ``offset``.

    Sequence numbers: shard * 2**32 + bin for packed pieces; negative ones for full pieces.
    """
    pieces = cut(cut_texts(docs, path, limit, end_id, doc_id, text))
    short = pieces.where(F.col("length") < limit)
    shards = parts_for(short.count(), shard_rows)
    key = F.pmod(F.xxhash64("doc_id", "copy", "piece", "ids_crc32"), F.lit(shards))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], ignore_index=True)
        number, offset = pack(rows["length"].to_numpy(), limit)
        rows["sequence_id"] = rows.pop("shard").astype("int64") * (1 << 32) + number
        rows["offset"] = offset
        return rows

    fields = "doc_id bigint, copy bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    packed = short.withColumn("shard", key).groupBy("shard").applyInPandas(place, f"{fields}, sequence_id bigint, offset bigint")
    full = pieces.where(F.col("length") >= limit).withColumns({
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full).drop("copy")
