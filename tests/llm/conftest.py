import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) pairs -> a documents table; ``extra`` adds columns that clash with names used inside."""

    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], DOCS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return make
