import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from coralint.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("coralint-tests", "local[4]", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """Build a ``files`` DataFrame from (path, source) pairs."""
    from pyspark.sql import functions as F

    from coralint.functions.paths import language_of

    def make(pairs):
        rows = [(i, path, source) for i, (path, source) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "fid long, path string, text string")
        return df.withColumn("language", language_of(F.col("path"))).withColumn("repo", F.lit("r"))

    return make
