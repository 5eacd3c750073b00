"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"

#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by bytes; 10,000 texts at once are held several times, by the executor and by its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits of id and text; used only next to the id itself."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def parts_for(rows: int, each: int) -> int:
    """Partitions so that each gets about ``each`` rows; grows with the data."""
    return max(1, -(-int(rows) // each))


class Bits:
    """A test on 64-bit values that is false only for values not among the keys of ``keys[key]``.

    The table of bits has a fixed size (2 MB), whatever the number of keys: many keys make it less
    selective, never wrong.  It thins out rows before a join that would shuffle their texts.
    """

    def __init__(self, keys: DataFrame, key: str, bits: int = 1 << 24):
        self.mask = bits - 1
        place = F.pmod(F.col(key), F.lit(bits))
        found = keys.select(place.alias("p")).distinct().groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("n")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits")).collect()
        table = bytearray(bits // 8)
        for row in found:
            start = (row["n"] - 1) * 4096
            table[start:start + 4096] = row["bits"]
        self.table = bytes(table)

    def hit(self, value: int) -> bool:
        at = value & self.mask
        return bool(self.table[at >> 3] >> (at & 7) & 1)

    def hits(self, values: np.ndarray) -> np.ndarray:
        at = values & self.mask
        return (np.frombuffer(self.table, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def split_by(rows: DataFrame, column: str, bits: Bits) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose 64-bit ``column`` may be among the keys, and those where it is not.

    Rows stream through ``mapInArrow``; a scalar UDF beside them would queue them on disk.
    """

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = bits.hits(batch.column(batch.schema.get_field_index(column)).to_numpy())
                yield batch.filter(pa.array(hit if wanted else ~hit))

        return rows.mapInArrow(run, rows.schema)

    return part(True), part(False)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; only a local session may use a temporary one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"
