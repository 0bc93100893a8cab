import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a (doc_id, text) table, with extra columns whose names clash with outputs if asked."""

    def make(rows, extra=False):
        df = spark.createDataFrame(rows, DOC)
        if extra:
            from pyspark.sql import functions as F

            for c in ("score", "ids", "hits", "simhash", "n_words", "N_Lines", "h", "group", "line", "key", "labels", "predicted", "shard"):
                df = df.withColumn(c, F.lit("own"))
        return df

    return make
