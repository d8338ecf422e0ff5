import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank and very long texts, ties, repeated rows, null ids and sources, and columns
    whose names clash with what operators add."""
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, LONG, "b"), (4, LONG, "b"), (5, "One two.\x01 three\x02", "b"),
        (6, "one TWO. three", None), (None, "one two. three", "a"), (None, None, None), (7, "é 𝔘 ß mail a@b.cd 10.0.0.1", "ä"),
        (8, "x" * 100_000, "a"), (9, "Same. " * 30, "a"), (10, "Same. " * 30, "a"), (11, LONG + "end", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("id", "fp", "key", "size", "hash", "shard", "slot", "total", "_row", "_id", "_t", "base", "spans", "score", "row", "n", "kept"):
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("false")
