import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    def docs(*texts):
        rows = [(i, t, "en", "a", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return docs


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables as a folder that a query can read."""

    def write(**tables):
        d = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return write
