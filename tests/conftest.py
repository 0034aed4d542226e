import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = spark_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A DataFrame from rows and a DDL schema; text in timestamp columns is cast."""
    def make(rows, ddl):
        from pyspark.sql import functions as F
        fields = [part.strip().split() for part in ddl.split(",")]
        plain = ", ".join(f"{n} {'string' if k == 'timestamp_ntz' else k}" for n, k in fields)
        df = spark.createDataFrame(rows, plain)
        return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n, k in fields if k == "timestamp_ntz"})
    return make
