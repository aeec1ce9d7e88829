import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names clash."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, "a b c d e f g", "en", "s", 3), (1, "a b c d e f g", "en", "s", 3), (2, "a b c d e f g", None, None, None), (3, "", "en", "s", 0), (4, None, "en", "t", None), (5, " \t\n ", "fr", "t", 4), (6, long, "en", "s", 1), (7, long + " tail", "en", "s", 1), (8, "one two", "en", "t", 7), (9, "ONE two", "en", "t", 7), (10, "é ñ 漢字 😀 ... 123", "es", "u", 9), (None, "a b c d e f g", "en", "s", 3), (None, None, None, None, None), (11, "x" * 50_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    clash = ["size", "kept", "text_crc32", "row", "shard", "rep", "bucket", "mh", "host", "_key", "n_words", "label", "taken", "score", "component_id"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf001(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
