import os

import pytest
from pyspark.sql import types as T

SF001 = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
                     T.StructField("fp", T.StringType()), T.StructField("th", T.LongType()), T.StructField("places", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang]) as a table of documents with extra columns whose names the operators use inside."""
    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), "x", "y", 7, 9) for r in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def texts001(spark):
    """All documents of the smallest table as (doc_id, text)."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(os.path.join(SF001, "documents.parquet")).select("doc_id", "text").collect()]
