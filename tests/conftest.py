import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowproof.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("rowproof-tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def numbered(spark):
    """A literal table with positions: numbered((cells...), "ddl")."""
    def make(rows, ddl):
        return spark.createDataFrame(
            [(*r, i) for i, r in enumerate(rows)], f"{ddl}, _ord bigint")
    return make
