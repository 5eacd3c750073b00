import pytest

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, hits int, gone string, row_key string"


def frame(spark, texts):
    """Rows (id, text) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 1, "x", None) for i, t in texts], FIELDS)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, null and repeated ids, repeated rows, ties, a very long text and one very long word."""
    line = "The same line stands in many of these documents."
    texts = [(1, None), (2, ""), (3, " \n\t\n "), (None, line), (4, line), (4, line), (5, line + "\n" + line.replace("many", "mang")),
             (6, "word " * 30_000), (7, "x" * 70_000), (8, line + "\nAnd the other line of it is here for once only."), (9, "Of\nOf\nOf"),
             (10, "é ü   \U0001f600 the and <|endoftext|> I'm"), (None, None)]
    return frame(spark, texts)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
