import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     # extra columns whose names the operators use themselves
                     *(T.StructField(n, T.IntegerType()) for n in ("n", "size", "shard", "score", "node", "band", "h", "cell", "stretch", "text_key", "page"))])


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])"""
        full = [(*r, *(None,) * (4 - len(r)), *range(len(DOCS) - 4)) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def real(spark, small):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (None, "one two three four"), (7, "x" * 200_000), (8, "word " * 60_000), (9, "12345 !!! ..."), (10, "a b   c"), (11, "\u0000 nul"), (4, "one"), (4, "one")]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
