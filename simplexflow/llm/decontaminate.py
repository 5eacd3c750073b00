"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance.

Texts and items are compared as bare words: lower case, every character that is ASCII
punctuation or white space counts as one blank.  An item of length n may differ by
``floor(rate * n)`` edits.  It is split in one piece more than that, so at least one piece
stands unchanged in any passage within the budget.  One automaton finds all pieces in one walk
over a text; around each hit a window is checked by Myers' algorithm, whose columns are
integers of n bits.

The automaton is sent to the tasks, so the benchmark is measured first; beyond ``shard_chars``
characters it is cut by a hash of the items, and the corpus is read once per shard.

Defined cases: a null or empty item matches nothing; an item with a null id is found under that id; an item below ``min_chars`` matches only a
text that is equal to it; null or empty texts match nothing; repeated items and rows are treated
each by itself; an empty benchmark or corpus gives no row; other columns pass through.
"""

from __future__ import annotations

import string

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexflow.llm.tables import parts_for, small_batches, spare

BLANK = bytes.maketrans(string.punctuation.encode() + b"\t\n\x0b\x0c\r", b" " * (len(string.punctuation) + 5))

HIT_TYPE = "array<struct<item_id:bigint,distance:int,start_char:int,end_char:int>>"


def bare(text: str | None) -> str:
    """Lower case words joined by one blank."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(BLANK).split()).decode("utf-8", "surrogatepass")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut in ``budget + 1`` pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least distance of ``pattern`` to a stretch of ``text`` and the first end of such a stretch.

    None if it is above the budget.  One addition and some logic on integers of the pattern's length
    per character, whatever the budget.
    """
    m = len(pattern)
    at: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        at[ch] = at.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, ch in enumerate(text, 1):
        eq = at.get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        up = (mh << 1 & full) | ~(xv | ph) & full
        down = ph & xv
        if score < best:
            best, end = score, j
    return (best, end) if best <= budget else None


class Matcher:
    """All items of one shard."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        self.items = [(i, b) for i, t in items if (b := bare(t))]
        self.short: dict[str, list[int]] = {}
        self.budget = [int(rate * len(b)) for _, b in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (i, b) in enumerate(self.items):
            if len(b) < min_chars:
                self.short.setdefault(b, []).append(i)
                continue
            for place, piece in pieces(b, self.budget[n]):
                found.setdefault(piece, []).append((n, place))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.ready = bool(found)
        if self.ready:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """The best passage of each item within its budget: item, distance, start and end in the bare text."""
        low = bare(text)
        out = [(i, 0, 0, len(low)) for i in self.short.get(low, ())] if low else []
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(low) if self.ready else ():
            for n, place in places:
                starts.setdefault(n, set()).add(end + 1 - length - place)
        for n, diagonals in starts.items():
            item_id, item = self.items[n]
            budget = self.budget[n]
            best: tuple[int, int, int] | None = None
            lo = hi = None
            for d in [*sorted(diagonals), None]:
                if d is not None and hi is not None and d - budget <= hi:
                    hi = d + len(item) + budget
                    continue
                if hi is not None:
                    lo = max(0, lo)
                    got = myers(item, low[lo:hi], budget)
                    if got and (best is None or got[0] < best[0]):
                        back = myers(item[::-1], low[lo:lo + got[1]][::-1], budget)
                        best = (got[0], lo + got[1] - back[1], lo + got[1])
                if d is not None:
                    lo, hi = d - budget, d + len(item) + budget
            if best:
                out.append((item_id, *best))
        return sorted(out, key=lambda h: (h[0] is not None, h))


def hits_column(items: list[tuple[int, str]], text: str, rate: float, min_chars: int) -> Column:
    held: list[Matcher] = []

    @F.pandas_udf(HIT_TYPE)
    def hits(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Matcher(items, rate, min_chars))
        names = ("item_id", "distance", "start_char", "end_char")
        return pd.Series([[dict(zip(names, h)) for h in held[0].hits(t)] for t in texts], dtype=object)

    return hits.asNondeterministic()(F.col(text))


def with_hits(docs: DataFrame, benchmark: DataFrame, into: str = "hits", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", rate: float = 0.06, min_chars: int = 20, shard_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with an array of hits: item, distance and place in the bare text."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    small_batches(docs.sparkSession)
    size = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    shards = parts_for(size, shard_chars)
    shard = F.pmod(F.xxhash64(item_id, item_text), F.lit(shards))
    parts = []
    for n in range(shards):
        items = [(r[0], r[1]) for r in benchmark.where(shard == n).select(item_id, item_text).collect()]
        part = spare(docs, f"hits_{n}")
        docs = docs.withColumn(part, hits_column(sorted(items, key=str), text, rate, min_chars))
        parts.append(part)
    return docs.withColumn(into, F.concat(*parts)).drop(*parts)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document and item found in it; items without an id cannot be named and are left out."""
    benchmark = benchmark.where(F.col(options.get("item_id", "item_id")).isNotNull())
    found = with_hits(docs.select(doc_id, options.get("text", "text")), benchmark, "hits", **options)
    return found.select(doc_id, F.explode("hits").alias("h")).select(doc_id, "h.*")


def clean_only(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark passage, with their columns."""
    name = spare(docs, "hits")
    return with_hits(docs, benchmark, name, **options).where(F.size(name) == 0).drop(name)
