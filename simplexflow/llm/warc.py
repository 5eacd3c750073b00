"""WARC archives: written with revisits of equal payloads, read back by boundary-chain verification.

Archives are plain text files of Spark's writer whose line end is the record end, so they are written and
read in parallel by any file system that Spark knows.  Readers split a file anywhere; each piece
between two record marks is a *candidate* record with a start and, by its Content-Length, a
successor.  A mark inside a payload makes false candidates, so only those reachable from the
file's start count:

1. per region of ``REGION`` bytes, every candidate's chain is followed to its exit from the region;
2. pointer jumping over the exits (each round doubles the distance) finds which region entries are reached
   from offset 0, in rounds of the logarithm of a file's regions;
3. chains inside the regions are followed again from the reached entries only.

A payload with marks inside is put together from its pieces; only these few pieces are shuffled.

Defined cases: a null payload is empty; payloads below ``min_bytes`` are never revisits; of rows with equal
payloads the least page_id is the response, and rows that repeat its id are responses too; null
ids stay null and sort first; line breaks in an url become blanks, a null url has no header; an empty
table gives no records; other columns are not written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexflow.llm.tables import Bits, split_by
from simplexflow.plans.lineage import cut

MARK = "WARC/1.1\r\n"
END = "\r\n\r\n"
REGION = 4 << 20


def with_responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, first``: ``first`` is the response that the record revisits, else null."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("key", F.xxhash64("digest"))
    long = F.octet_length("payload") >= min_bytes
    same = rows.where(long).groupBy("digest", "key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = cut(same.select("digest", "key", "first"))
    met, alone = split_by(rows, "key", Bits(same, "key"))
    alone = alone.withColumn("first", F.lit(None).cast("bigint"))
    met = met.join(same.drop("key"), "digest", "left")  # none of the short ones has a first
    met = met.withColumn("first", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))
    names = ("page_id", "url", "payload", "digest", "first")
    return alone.select(*names).unionByName(met.select(*names))


def write(pages: DataFrame, folder: str, **names) -> None:
    """One record per page in text files below ``folder``."""
    rows = with_responses(pages, **names)
    line = lambda name, *parts: F.concat(F.lit(f"{name}: "), *parts, F.lit("\r\n"))
    again = F.col("first").isNotNull()
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MARK),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.lit("<urn:page:"), number("page_id"), F.lit(">")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " "))).otherwise(""),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        F.when(again, line("WARC-Refers-To", F.lit("<urn:page:"), number("first"), F.lit(">"))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body)
    rows.select(record.alias("value")).write.option("lineSep", END).text(folder)


def header(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Header length with its empty line, content length and fields; None if it is no header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    return (end + 4, int(size), fields) if size.isdecimal() else None


def _pieces(with_body: bool):
    """Pieces between marks with their place in the block; ``local`` is the place of the mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, 0
        for batch in batches:
            rows = []
            for file, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (file, start) != block:
                    block, at = (file, start), 0
                raw = value.as_py()
                head = header(raw)
                size = head[0] + head[1] + 4 if head else None
                rows.append((file, start, at - len(MARK), len(raw), size, raw if with_body else None))
                at += len(raw) + len(MARK)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)] if rows else
                                             [pa.array([], f.type) for f in PIECES], schema=PIECES)

    return run


PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("local", pa.int64()), ("length", pa.int64()), ("size", pa.int64()), ("raw", pa.binary())])


def pieces(spark: SparkSession, folder: str, with_body: bool) -> DataFrame:
    """``file, block, local, length, size, raw``: ``size`` is that of a record by its own header, from the mark's end to the record's."""
    rows = spark.read.option("lineSep", MARK).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(_pieces(with_body), "file string, block bigint, local bigint, length bigint, size bigint, raw binary")


def _exits(size: int):
    """Where each candidate's chain leaves its region of ``size`` bytes, null if it breaks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("off", ascending=False, ignore_index=True)
        known: dict[int, int | None] = {}
        end = (rows["region"].iloc[0] + 1) * size
        for off, succ in zip(rows["off"].tolist(), rows["succ"].tolist()):
            known[off] = None if succ != succ or succ is None else int(succ) if succ >= end else known.get(int(succ))
        rows["exit"] = pd.array([known[o] for o in rows["off"].tolist()], dtype="Int64")
        return rows[["file", "region", "off", "exit"]]

    return run


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates on chains from the reached entries of a region."""
    succ = dict(zip(rows["off"].tolist(), rows["succ"].tolist()))
    on = set()
    for at in rows.loc[rows["entry"] == True, "off"].tolist():  # noqa: E712
        while at in succ and at not in on:
            on.add(at)
            nxt = succ[at]
            at = int(nxt) if nxt == nxt and nxt is not None else -1
    rows["reached"] = rows["off"].isin(on)
    return rows[["file", "off", "reached"]]


def reachable(candidates: DataFrame, region: int = REGION) -> DataFrame:
    """``file, off, reached`` from ``file, off, succ`` (null: no header)."""
    rows = cut(candidates.withColumn("region", F.floor(F.col("off") / region)))
    exits = cut(rows.groupBy("file", "region").applyInPandas(_exits(region), "file string, region bigint, off bigint, exit bigint"))
    heads = exits.where("exit is not null").select("file", F.col("exit").alias("off")).unionByName(
        exits.where("off = 0").select("file", "off")).distinct()
    hops = cut(exits.join(heads, ["file", "off"]).select("file", "off", F.col("exit").alias("jump"), (F.col("off") == 0).alias("reached")))
    while not hops.where("jump is not null").isEmpty():
        onward = hops.where("reached").select("file", F.col("jump").alias("off"), F.lit(True).alias("new")).distinct()
        further = hops.select("file", F.col("off").alias("jump"), F.col("jump").alias("next"))
        hops = hops.join(further, ["file", "jump"], "left").join(onward, ["file", "off"], "left")
        hops = cut(hops.select("file", "off", F.col("next").alias("jump"), (F.col("reached") | F.coalesce("new", F.lit(False))).alias("reached")))
    entries = hops.where("reached").select("file", "off", F.lit(True).alias("entry"))
    marked = rows.join(entries, ["file", "off"], "left").select("file", "region", "off", "succ", "entry")
    return marked.groupBy("file", "region").applyInPandas(_walk, "file string, off bigint, reached boolean")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw in batch.column(0):
            piece = raw.as_py()
            start, size, fields = header(piece)
            name = lambda key: int(v) if (v := fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdecimal() else None
            rows.append((name("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), name("warc-refers-to"),
                         fields.get("warc-payload-digest", "").removeprefix("sha256:"), piece[start:start + size]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORDS)] if rows else
                                         [pa.array([], f.type) for f in RECORDS], schema=RECORDS)


RECORDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("said_digest", pa.string()),
                     ("payload", pa.binary())])


def read(spark: SparkSession, folder: str, region: int = REGION) -> DataFrame:
    """The records of all archives below ``folder``: ``page_id, record_type, url, refers_to, said_digest, payload``."""
    first = cut(pieces(spark, folder, False).drop("raw"))
    blocks = first.groupBy("file", "block").agg(F.sum(F.col("length") + len(MARK)).alias("n"))
    before = F.coalesce(F.expr("sum(n) over (partition by file order by block rows between unbounded preceding and 1 preceding)"), F.lit(0))
    placed = first.join(blocks.select("file", "block", before.alias("base")), ["file", "block"])
    placed = placed.withColumn("off", F.col("base") + F.col("local")).where("off >= 0")  # what stands before a file's first mark is no record
    placed = cut(placed.withColumn("succ", F.col("off") + len(MARK) + F.col("size")))
    reached = reachable(placed.select("file", "off", "succ"), region)
    spots = placed.join(reached, ["file", "off"])
    # A record is whole where its own piece holds it; else its start and the false candidates after it are special.
    whole = F.col("reached") & (F.col("size") == F.col("length"))
    special = cut(spots.where(~whole).select("file", "block", "local", "off", "succ", "reached", F.xxhash64("file", "block", "local").alias("key")))
    body = pieces(spark, folder, True).withColumn("key", F.xxhash64("file", "block", "local")).where((F.col("block") > 0) | (F.col("local") >= 0))
    met, plain = split_by(body, "key", Bits(special, "key"))
    plain = plain.select("raw")
    met = met.join(special.drop("key"), ["file", "block", "local"], "left")
    plain = plain.unionByName(met.where("off is null").select("raw"))
    owner = F.expr("last(case when reached then off end, true) over (partition by file order by off)")
    parts = special.select("file", "off", "succ", "reached", owner.alias("owner"))
    ends = parts.where("reached").select("file", F.col("off").alias("owner"), F.col("succ").alias("owner_end"))
    inside = parts.join(ends, ["file", "owner"]).where(F.col("off") < F.col("owner_end")).select("file", "off", "owner")
    joined = met.where("off is not null").join(inside, ["file", "off"]).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("off", "raw"))).alias("parts"))  # the pieces of one record
    glued = joined.select(F.expr(f"aggregate(slice(parts, 2, size(parts)), parts[0].raw, (s, x) -> concat(s, X'{MARK.encode().hex()}', x.raw))").alias("raw"))
    fields = "page_id bigint, record_type string, url string, refers_to bigint, said_digest string, payload binary"
    return plain.unionByName(glued).mapInArrow(_records, fields)


def resolved(records: DataFrame) -> DataFrame:
    """Per record: id, type, ``refers_to`` and size and SHA-256 of the full payload, for revisits that of their response.

    A revisit names its response by id and digest, since ids may repeat.
    """
    own = records.select("page_id", "record_type", "refers_to", "said_digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
                         F.sha2("payload", 256).alias("payload_digest"))
    own = cut(own)
    full = own.where("record_type = 'response'")
    first = full.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said_digest"), "payload_bytes", "payload_digest").distinct()
    again = own.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(first, ["refers_to", "said_digest"], "left")
    return full.unionByName(again).drop("said_digest")
