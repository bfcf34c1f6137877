import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from landq.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "landq-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Applies a column function to a column of texts."""

    def run(function, *inputs):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
        return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]

    return run
