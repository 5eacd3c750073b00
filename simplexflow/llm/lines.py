"""Line deduplication by a deletion-neighbourhood join, within one edit.

A line counts if it has at least ``min_words`` words; it is compared without outer ASCII white space.
Its first place is the least (id, text hash, line number).  A line is dropped where it is not in its
first place, or if a line within one edit has an earlier first place; so the earliest stays.

All lines of all documents take part, in four steps:

1. distinct lines, as a 128-bit hash with first place, count and the hashes of their half lines,
   by one partial aggregate (a line that a third of the documents share is one row per task);
2. of two lines within one edit, one half stands unchanged in both, so only lines that share a half with
   another line go on; these are read again as text and thinned out in the same way by sixteenths;
3. each of them emits the keys of its deletion neighbourhood: the hash of the line and of all
   lines with one character less.  A line and a deletion variant that are equal are an insertion
   apart; two variants equal at the same place are a substitution apart.  Keys are counted first, and
   those that one line alone has are not joined.  Per key only the earliest
   line is kept, so a key with very many lines gives one candidate for each line and never
   all pairs; candidates are verified by edit distance;
4. the dropped places are gathered per document and cut out of its text.

Defined cases: null and empty texts are unchanged; lines below ``min_words`` words are never dropped;
rows with equal id and text get equal results; null ids sort first; empty tables stay empty; all
columns stay as they are, except that the text is shortened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from simplexflow.llm.tables import Bits, row_key, small_batches, spare, split_by
from simplexflow.plans.lineage import cut

LINE = ["a", "b"]  # the two halves of a line's hash
OUTER = b" \t\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)


def _line_scan(fields: list[str], types: pa.Schema, min_words: int, bits: Bits | None):
    """Rows of the lines that count; with ``bits`` only of those whose hash may be among its keys.

    Without ``bits`` equal lines of a partition are one row with their number and least place.
    """

    def place(row: tuple) -> tuple:
        return (row[0] is not None, *row[:3])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            for no, raw in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                line = raw.strip(OUTER)
                if line and len(line.split(None, min_words - 1)) >= min_words:
                    a = xxhash.xxh64_intdigest(line, 42)
                    if bits is None or bits.hit(a):
                        yield doc, key, no, line, a

    def signed(h: int) -> int:
        return h - (h >> 63 << 64)

    def packed(table: dict[bytes, tuple]) -> pa.RecordBatch:
        out = []
        for line, (doc, key, no, n, a) in table.items():
            text = line.decode("utf-8", "surrogatepass")
            halves = [signed(xxhash.xxh64_intdigest(f"{side}|{size}|{part}".encode("utf-8", "surrogatepass"), 44)) for side, size, part in half_pieces(text)]
            out.append((doc, key, no, signed(a), signed(xxhash.xxh64_intdigest(line, 43)), n, *halves))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)] if out else [pa.array([], f.type) for f in types], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, tuple] = {}
        for batch in batches:
            if bits is None:
                for doc, key, no, line, a in rows(batch):
                    old = table.get(line)
                    if old is None:
                        table[line] = (doc, key, no, 1, a)
                    else:
                        table[line] = (*min(old[:3], (doc, key, no), key=place), old[3] + 1, a)
                if len(table) > 20_000:
                    yield packed(table)
                    table = {}
            else:
                out = [(doc, key, no, signed(a), signed(xxhash.xxh64_intdigest(line, 43)), line.decode("utf-8", "surrogatepass"))[:len(fields)]
                       for doc, key, no, line, a in rows(batch)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)] if out else [pa.array([], f.type) for f in types], schema=types)
        if bits is None:
            yield packed(table)

    return run


def half_pieces(line: str) -> list[tuple[int, int, str]]:
    """Side, length and text of prefix and suffix halves: for the line's own length and for one less.

    Of two lines within one edit one half stands unchanged; cut as the shorter one is, either the front at
    the same place from the left or the back at the same place from the right.
    """
    n = len(line)
    return [(0, n // 2, line[:n // 2]), (0, (n - 1) // 2, line[:(n - 1) // 2]), (1, (n + 1) // 2, line[n - (n + 1) // 2:]), (1, n // 2, line[n - n // 2:])]


def line_rows(docs: DataFrame, id_col: str, text: str, min_words: int, bits: Bits | None = None, with_line: bool = False) -> DataFrame:
    """Lines that count, as ``id, row_key, no, a, b``: with ``bits`` every place of the lines it lets through
    (and their text), without it distinct lines per partition with number ``n`` and half hashes ``h0`` to ``h3``."""
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("row_key"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType
    fields = ["id", "row_key", "no", "a", "b", *(["line"] if with_line else []), *(["n", "h0", "h1", "h2", "h3"] if bits is None else [])]
    spark_types = {"id": kind, "no": IntegerType(), "line": StringType()}
    schema = StructType([StructField(f, spark_types.get(f, LongType())) for f in fields])
    return rows.mapInArrow(_line_scan(fields, to_arrow_schema(schema), min_words, bits), schema)


def piece_keys(pieces: int) -> Column:
    """Hashes of a line without one of its pieces, for its own length and for one less.

    Of two lines within one edit, cut as the shorter one is, all pieces but one stand unchanged:
    those before it at the same place from the left, those after it at the same place from the right.
    """
    keys = []
    for less in (0, 1):
        n = F.length("line") - less
        edge = lambda i, n=n: F.floor(n * i / pieces).cast("int")
        for i in range(pieces):
            rest = n - edge(i + 1)
            keys.append(F.xxhash64(n, F.lit(i), F.substring(F.col("line"), F.lit(1), edge(i)), F.substring(F.col("line"), F.length("line") - rest + 1, rest)))
    return F.array_distinct(F.array(*keys))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, kinds (0 the line itself, 1 a line with one character less, 2 the same with the place).

    Rolling hashes: every variant costs a few operations, whatever the line's length.
    """
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    n = len(code)
    with np.errstate(over="ignore"):
        mixed = _mixed(code * np.uint64(0xD6E8FEB86659FD93))
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)
        front = np.r_[np.uint64(0), np.cumsum(mixed * power[:n], dtype=np.uint64)]  # characters before i
        back = np.cumsum((mixed * power[:n])[::-1], dtype=np.uint64)[::-1]  # characters from i on
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        rest = np.r_[back[1:], np.uint64(0)] * inverse  # one place further left
        drop = _mixed(front[:n] + rest + np.uint64(n - 1))
        whole = _mixed(front[n:] + np.uint64(n))
        spots = np.unique(drop)  # equal letters in a row give the same variant
        placed = _mixed(drop ^ _mixed(np.arange(1, n + 1, dtype=np.uint64)))
    keys = np.concatenate([whole, spots, placed]).view(np.int64)
    return keys, np.repeat(np.array([0, 1, 2], dtype=np.int8), [1, len(spots), n]), code


KEYS = pa.schema([("n", pa.int64()), ("key", pa.int64()), ("kind", pa.int8())])


def _emit_keys(bits: Bits | None):
    """All keys of the lines, without names; with ``bits`` name, key and kind of those keys that it lets through."""

    def made(n: int, line: str) -> list[np.ndarray]:
        key, kind, _ = deletion_keys(line)
        if bits is None:
            return [key]
        hit = bits.hits(key)
        return [np.full(np.count_nonzero(hit), n), key[hit], kind[hit]]

    schema = KEYS if bits is not None else pa.schema([KEYS.field("key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for n, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.append(made(n, line.as_py()))
                size += len(parts[-1][0])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=schema)
                    parts, size = [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=schema)

    return run


def _sharing(rows: DataFrame, keys: str, names: list[str]) -> DataFrame:
    """Names of rows that share one of their ``keys`` with another row."""
    each = rows.select(*names, F.explode(keys).alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n_lines")).where("n_lines > 1")
    return each.join(shared, "key", "left_semi").select(*names).distinct()


def near_lines(distinct: DataFrame, lines, fine: int = 16) -> DataFrame:
    """Hashes ``a``, ``b`` of lines that have an earlier line within one edit.

    ``distinct``: a, b, first, halves; ``lines(bits, with_line)`` gives the lines that ``bits`` lets through.  Lines that share all but one of two, then of ``fine`` pieces go on.
    """
    close = cut(_sharing(distinct, "halves", LINE).join(distinct.select(*LINE, "first"), LINE))
    text = lines(Bits(close, "a"), True).join(close, LINE)
    text = text.where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row_key") == F.col("first.row_key")) & (F.col("no") == F.col("first.no")))
    text = text.select("first", *LINE, "line")
    text = cut(text.withColumn("n", F.xxhash64(*LINE)).dropDuplicates(["n"]))  # rows with equal place are copies of one row
    text = cut(text.join(_sharing(text.withColumn("keys", piece_keys(fine)), "keys", ["n"]), "n"))
    # Nearly all keys belong to one line: they are counted as bare numbers, and only keys of two lines or more are emitted with names.
    met_twice = text.select("n", "line").mapInArrow(_emit_keys(None), "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keys = text.select("n", "line").mapInArrow(_emit_keys(Bits(met_twice, "key")), "n bigint, key bigint, kind tinyint")
    keys = keys.withColumn("group", F.when(F.col("kind") == 2, 2).otherwise(1)).join(text.select("n", "first"), "n")
    met = F.struct("first", "n")
    best = keys.groupBy("group", "key").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("kind") == 0, met)).alias("whole"),
        F.min(F.when(F.col("kind") > 0, met)).alias("short")).where("size > 1")
    other = F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("short"))
    pairs = keys.join(best, ["group", "key"]).select("n", "first", other.alias("o")).where(F.col("o.first") < F.col("first"))
    pairs = pairs.select("n", F.col("o.n").alias("m")).distinct()
    left = text.select("n", *LINE, F.col("line").alias("x"))
    right = text.select(F.col("n").alias("m"), F.col("line").alias("y"))
    return pairs.join(left, "n").join(right, "m").where(F.levenshtein("x", "y", 1).between(0, 1)).select(*LINE).distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 3) -> DataFrame:
    """``id``, ``row_key`` and the sorted line numbers ``gone`` (from 0) of every document that loses lines."""
    first = F.min(F.struct("id", "row_key", "no"))
    halves = F.array(*[F.first(f"h{k}") for k in range(4)])
    distinct = cut(line_rows(docs, id_col, text, min_words).groupBy(*LINE).agg(
        first.alias("first"), F.sum("n").alias("n_places"), F.array_distinct(halves).alias("halves")))

    def lines(bits: Bits, with_line: bool = False) -> DataFrame:
        return line_rows(docs, id_col, text, min_words, bits, with_line)

    near = near_lines(distinct, lines)
    out = distinct.select(*LINE, "first", "n_places").join(near.withColumn("near", F.lit(True)), LINE, "left")
    out = out.where("n_places > 1 or near").select(*LINE, "first", F.coalesce("near", F.lit(False)).alias("near"))
    out = cut(out)
    here = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row_key") == F.col("first.row_key")) & (F.col("no") == F.col("first.no"))
    gone = lines(Bits(out, "a")).join(out, LINE).where(F.col("near") | ~here)
    return gone.groupBy("id", "row_key").agg(F.array_sort(F.collect_set("no")).alias("gone"))


@F.pandas_udf(StringType())
def without_lines(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def cleaned(text, drop):
        if text is None:
            return None
        drop = set(drop)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)

    return pd.Series([cleaned(t, g) for t, g in zip(texts, gone)], dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 3, gone: str | None = None) -> DataFrame:
    """``docs`` with later copies of lines cut out; with ``gone`` also the dropped line numbers."""
    small_batches(docs.sparkSession)
    number, key, other, own = (spare(docs, name) for name in ("gone", "row_key", "other_id", "own_key"))
    drops = cut(dropped_lines(docs, id_col, text, min_words).select(F.col("id").alias(other), F.col("row_key").alias(key), F.col("gone").alias(number)))
    touched, same = split_by(docs.withColumn(own, row_key(id_col, text)), own, Bits(drops, key))
    same = same.select(*docs.columns, *([F.lit(None).cast("array<int>").alias(gone)] if gone else []))
    met = touched.join(drops, F.col(id_col).eqNullSafe(F.col(other)) & (F.col(own) == F.col(key)), "left")
    some = F.col(number).isNotNull()
    shorter = without_lines(F.when(some, F.col(text)), F.when(some, F.col(number)))
    met = met.withColumn(text, F.when(some, shorter).otherwise(F.col(text)))
    return same.unionByName(met.select(*docs.columns, *([F.col(number).alias(gone)] if gone else [])))
