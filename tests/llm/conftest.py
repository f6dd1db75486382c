import pytest


@pytest.fixture
def frame(spark):
    """frame(rows, schema): a small table in several partitions."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)
    return make
