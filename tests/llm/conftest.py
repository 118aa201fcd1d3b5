import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """Tables that operators cut their lineage with go to a folder of the test run."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
