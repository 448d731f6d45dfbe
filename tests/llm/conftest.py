import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # names that operators use inside must not clash
        T.StructField("node", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("prefix", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "n", 1, 2) for i, t in rows], SCHEMA).repartition(3)

    return make
