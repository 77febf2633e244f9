import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("a", T.LongType()), T.StructField("runs", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text) pairs, with further columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).repartition(2)

    return make


#: Nulls, empty and long texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "a text without an id"), (5, "word " * 20_000), (6, "same words in this text again"), (7, "same words in this text again"), (7, "same words in this text again"), (8, "é ß 漢字   😀 end")]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)


@pytest.fixture(scope="session")
def none(docs):
    return docs([])
