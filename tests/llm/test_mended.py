"""Plain inputs that once gave wrong rows."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from simplexflow.llm import decontaminate, lines, quality, simhash, tables, toxicity, warc
from simplexflow.llm.tables import shared_folder


def test_pages_that_share_an_id_keep_their_own_payloads(spark):
    pages = [(1, "u", "A" * 200), (1, "v", "B" * 200), (2, "w", "A" * 200), (3, "x", "B" * 200)]
    folder = shared_folder(spark, "warc")
    warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string"), folder)
    rows = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(warc.read(spark, folder)).collect())
    a, b = (hashlib.sha256(x * 200).hexdigest() for x in (b"A", b"B"))
    assert sorted(rows, key=str) == sorted([(1, a, "response", None), (1, b, "response", None), (2, a, "revisit", 1), (3, b, "revisit", 1)], key=str)


def test_a_column_named_like_the_inner_key_comes_back(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "kept"), (2, "other words stand in this text", "too")], "doc_id bigint, text string, _own_key string")
    docs = docs.withColumn("own_key", F.lit("mine"))
    assert sorted(tuple(r) for r in simhash.keep_one(docs).collect()) == sorted(tuple(r) for r in docs.collect())


def test_an_item_without_an_id_is_found(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "clean words only")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, passage), (7, passage)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect() if r.item_id) == [(1, 7)]
    assert decontaminate.leaks(docs, items).count() == 2
    assert [r.doc_id for r in decontaminate.clean_only(docs, items.limit(1)).collect()] == [2]


def test_a_row_without_an_id_is_not_held_out(spark):
    docs = spark.createDataFrame([(None, "some words"), (3, "more words")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(3, 1)], "doc_id bigint, toxic int")
    assert all(r.held_out is not None for r in toxicity.judged(docs, labels).collect())


def test_batches_to_python_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    long = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("word "), 4000).alias("text"))
    passage = "the quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(1, "x " * (tables.BATCH_BYTES // 2) + passage), (2, "clean words only")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    stages = {"quality": quality.keep_good, "lines": lines.dedup_lines, "simhash": simhash.keep_one, "decontaminate": lambda d: decontaminate.clean_only(d, items)}
    for name, stage in stages.items():
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        out = stage(docs)
        assert long.mapInArrow(sizes, "bytes bigint").agg(F.max("bytes")).first()[0] < 2 * tables.BATCH_BYTES, name
    assert [r.doc_id for r in out.collect()] == [2]
