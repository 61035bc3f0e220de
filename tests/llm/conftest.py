import pytest

from .helpers import EDGES, SCHEMA, make


@pytest.fixture(scope="session")
def edges(spark):
    n = len(EDGES)
    return make(spark, EDGES, sources=[None, "b", "b", "é", "a", None, "a", "a", "a", "hot", "hot", "hot"], langs=[None, "en"] * (n // 2)).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
